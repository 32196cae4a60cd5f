"""The corpus pipeline: stages over documents, each an operator of ``auditspan.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all
but the last return the columns of documents.  Decisions hold for an id together with its text,
so rows of one id with different texts are judged apart, and rows without an id like all others.
Nulls: a null text is scored like an empty one, matches nothing and packs as the end id alone.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspan.llm import decontamination, jaccard, packing, quality, secrets
from auditspan.llm.queries import table, tokenizer_path
from auditspan.llm.tasks import fold, kept_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: documents whose probability of label 1 is below this go
KEEP_SCORE = 0.3


def text_key() -> Column:
    """128 bits that stand for a text where decisions are carried back to rows."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not reject."""
    network = quality.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return quality.with_score(docs.select(*COLUMNS), network).filter(F.col("score") >= KEEP_SCORE).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that with the smallest id, rows without an id last.

    Rows with the same id and text are copies too.  Texts without words are copies of nothing.
    """
    # no null inside: rows without an id come after all others
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                   text_key().alias("text"))
    keyed = docs.select(*COLUMNS, key.alias("row"))
    found = jaccard.near_duplicate_classes(keyed.select(F.col("row").alias("doc_id"), "text"), width=5, percent=80)
    # rows that another one stands for, and rows that are repeated; all other rows stay as they are
    decided = kept_table(found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("row")).agg(
        F.max(F.col("component_id") < F.col("doc_id")).alias("gone"), F.count(F.lit(1)).alias("n"))
        .filter("gone or n > 1").select("row", "gone"), "copies")
    # one exchange of the texts by their row, alike at every size: both branches read it, and equal rows meet in it
    judged = keyed.join(decided.hint("shuffle_hash"), "row", "left")
    single = judged.filter("gone is null").select(*COLUMNS)
    repeated = judged.filter("not gone").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return single.union(repeated)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    keyed = docs.select(*COLUMNS, text_key().alias("key"))
    found = decontamination.contaminated(keyed, table(spark, sf_dir, "benchmark"), doc_id="key")
    gone = found.select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(gone, "key", "left_anti").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark."""
    found = secrets.redact(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", ngram_jaccard_join),
          ("benchmark decontamination", benchmark_decontamination), ("secret scans", secret_scans),
          ("packing", pack_sequences)]
#: a trained network and a tokenizer have no SQL form; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = kept_table(docs, "stage")
    return docs
