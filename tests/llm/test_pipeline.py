"""Stages of the pipeline against plain versions on the smallest tables, and queries against SQL."""
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", ["op2_benchmark_decontamination", "op4_substring_dedup", "op6_url_filters",
                                  "op7_ngram_jaccard_join"])
def test_query_equals_oracle(spark, name):
    from auditspan.llm.queries import ORACLE, QUERIES
    from workload import verify
    difference, _ = verify.compare(QUERIES[name](spark, SF), verify.duck(SF), ORACLE[name])
    assert difference is None


def test_stages(spark):
    import corpus_pipeline as pipeline
    from auditspan.llm import decontamination, quality, secrets
    from auditspan.llm.packing import Encoder
    from auditspan.llm.queries import table, tokenizer_path
    from auditspan.llm.tasks import fold, kept_table
    from tests.llm.test_text_operators import split

    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, "a b", "en", "s", 3)],
                                  docs.schema)
    docs = kept_table(docs.union(extra), "docs")
    results = [docs]
    for _, stage in pipeline.STAGES:
        results.append(kept_table(stage(spark, results[-1], SF), "stage"))
    assert all(r.columns == list(pipeline.COLUMNS) for r in results[1:-1])
    rows = [{r.doc_id: r for r in x.collect()} for x in results[:-1]]
    # the quality stage drops what the same network rejects
    net = quality.fit(docs, table(spark, SF, "labels").filter(fold("doc_id", 5) != 0))
    assert set(rows[1]) == {i for i, r in rows[0].items() if net.score((r.text or "").encode()) >= pipeline.KEEP_SCORE}
    # near copies: no two left link, and everything dropped links to something of its class
    sets = {}
    for i, r in rows[1].items():
        w = split(r.text, True)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def like(a, b):
        return bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    left = list(rows[2])
    assert not any(like(a, b) for k, a in enumerate(left) for b in left[:k])
    assert all(any(like(a, b) for b in rows[1] if b != a) for a in set(rows[1]) - set(rows[2]))
    # decontamination: nothing that holds a whole passage stays
    passages = [b" ".join(split(r.text, True)) for r in table(spark, SF, "benchmark").collect()]
    assert not any(p in b" ".join(split(r.text, True)) for r in rows[3].values() for p in passages if p)
    gone = {r.doc_id for r in decontamination.contaminated(results[2], table(spark, SF, "benchmark")).collect()}
    assert set(rows[3]) == set(rows[2]) - gone
    # secrets: no pattern left, all else unchanged
    bits = secrets.word_bits()
    for i, r in rows[4].items():
        before = rows[3][i].text
        spans = [] if before is None else secrets.base_spans(before) + secrets.guess_spans(before, bits, secrets.MIN_BITS)
        assert r.text == (before if before is None else secrets.redacted(before, spans, "[SECRET]"))
        assert r.n_chars == (None if r.text is None else len(r.text))
    # packing holds every document's ids once
    encoder, found = Encoder(tokenizer_path()), {}
    for p in results[-1].collect():
        found.setdefault(p.doc_id, []).append((p.start, p.ids))
    assert {i: b"".join(x for _, x in sorted(f)) for i, f in found.items()} == \
        {i: encoder.ids(r.text or "") for i, r in rows[4].items()}
