"""The queries of the text operators over the given tables, and their DuckDB twins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspan.llm import (decontamination, divergence, exact_dedup, fill_middle, fingerprints, jaccard, language, packing,
                           quality, secrets, substrings, toxicity, url_filters)
from auditspan.llm.tasks import fold

ABC, abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op2_sql() -> str:
    """Every alignment of a document with an item that has enough equal words at all, window by window; no seeds."""
    window, share = decontamination.WINDOW, decontamination.SIMILARITY
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{ABC}', '{abc}'), '[ \\t-\\r]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, * FROM (SELECT DISTINCT doc_id AS id, {words} AS words FROM documents)),
b AS (SELECT row_number() OVER () AS row, * FROM (SELECT DISTINCT item_id AS id, {words} AS words FROM benchmark)),
d_at AS (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS p FROM d),
b_at AS (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS p, least({window}, len(words)) AS length FROM b),
shifts AS (SELECT d.row AS d_row, b.row AS b_row, d.p - b.p AS shift, length FROM d_at d JOIN b_at b USING (word)
  GROUP BY ALL HAVING count(*) >= ceil({share} * length)),
windows AS (SELECT d.id AS doc_id, b.id AS item_id, d.words AS dw, b.words AS bw, shift, length,
  unnest(range(greatest(0, -shift), least(len(b.words), len(d.words) - shift) - length + 1)) AS i
  FROM shifts JOIN d ON d.row = d_row JOIN b ON b.row = b_row),
scored AS (SELECT doc_id, item_id, length, i + shift AS place,
  len(list_filter(range(length), lambda j: dw[i + j + shift + 1] = bw[i + j + 1])) AS matched FROM windows),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, place) AS r
  FROM scored WHERE matched >= ceil({share} * length))
SELECT doc_id, item_id, place AS doc_start, length AS window_words, matched AS matched_words FROM best WHERE r = 1"""


SITE_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
              ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*(url_filters.site_rule(*r) for r in SITE_RULES), *url_filters.METHOD_RULES]
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", F.when(F.col("site"), F.col("rule")).alias("rule"),
                         F.coalesce("action", F.lit("allow")).alias("verdict"))


def _op6_sql() -> str:
    fits = [f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}') THEN '{host}{path}'"
            for _, host, path in sorted(SITE_RULES, key=lambda r: -len(r[1] + r[2]))]
    actions = " ".join(f"WHEN rule = '{h}{p}' THEN '{a}'" for a, h, p in SITE_RULES)
    patterns = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in url_filters.METHOD_RULES)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{ABC}', '{abc}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE {actions} WHEN {patterns} THEN 'block' ELSE 'allow' END AS verdict FROM r"""


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(fold("doc_id", 4) != 2))
    found = language.identify(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = quality.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return _scores(quality.score(docs, network), 5, 0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def _op4_sql() -> str:
    w = substrings.WIDTH
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
  list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT row, p, array_to_string(words[p + 1 : p + {w}], ' ') AS seq FROM
  (SELECT row, words, unnest(range(len(words) - {w - 1})) AS p FROM d WHERE len(words) >= {w})),
r AS (SELECT row, p FROM s WHERE seq IN (SELECT seq FROM s GROUP BY seq HAVING count(*) > 1)),
gone AS (SELECT row, list(DISTINCT q) AS spots FROM (SELECT row, unnest(range(p, p + {w})) AS q FROM r) GROUP BY row),
kept AS (SELECT doc_id, words, coalesce(len(spots), 0) AS n_removed, CASE WHEN spots IS NULL THEN words ELSE
  list_transform(list_filter(list_zip(words, range(len(words))), lambda x: NOT list_contains(spots, x[2])), lambda x: x[1])
  END AS stay FROM d LEFT JOIN gone USING (row))
SELECT doc_id, len(words) AS n_words, n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = fold("doc_id", 4) != 2
    model = toxicity.fit(docs.filter(learned), table(spark, sf_dir, "labels").filter(learned))
    return _scores(toxicity.score(docs, model), 4, 2)


def _scores(scored: DataFrame, parts: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_classes(table(spark, sf_dir, "documents"), width=3, percent=90)


def _op7_sql() -> str:
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{ABC}', '{abc}'), '[ \\t-\\r]+'), " \
            "lambda w: w <> '')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[p + 1 : p + 3], ' ') AS shingle FROM
  (SELECT doc_id, words, unnest(range(greatest(len(words) - 2, 1))) AS p FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), with_text=False))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


_OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS n, regexp_replace(t, '[ \\t-\\r]', '', 'g') AS content FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(content) AS text_sha256
FROM n WINDOW w AS (PARTITION BY content ORDER BY n DESC, doc_id NULLS LAST)"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.rewritten(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


_OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def _op13_sql() -> str:
    least, top, scale = divergence.LEAST_DOCS, divergence.TOP_TERMS, divergence.SCALE
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), '{ABC}', '{abc}') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {least}),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN own USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n, k.n AS lang_n, l.total AS lang_total, l.v,
  1 + ({scale} * (coalesce(own.n, 0) + 2)) // (g.total + 2 * l.v) AS p
  FROM groups g JOIN langs l USING (lang) JOIN kept k ON k.lang = g.lang
  LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
q AS (SELECT *, 1 + ({scale} * (lang_n + 2)) // (lang_total + 2 * v) AS q FROM p WHERE n > 0),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM q WHERE p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_benchmark_decontamination, op3_quality_classifier, op4_substring_dedup, op5_toxicity, op6_url_filters,
    op7_ngram_jaccard_join, op8_packing, op9_document_fingerprints, op10_secret_scans, op11_exact_dedup,
    op12_fill_in_middle, op13_source_divergence)}
ORACLE = {"op2_benchmark_decontamination": _op2_sql(), "op4_substring_dedup": _op4_sql(), "op6_url_filters": _op6_sql(),
          "op7_ngram_jaccard_join": _op7_sql(), "op11_exact_dedup": _OP11_SQL, "op12_fill_in_middle": _OP12_SQL,
          "op13_source_divergence": _op13_sql()}
