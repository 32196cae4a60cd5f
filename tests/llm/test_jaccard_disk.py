"""What operator 7 writes where shingles outnumber the sketch or texts repeat, and its classes there, against brute force."""
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspan.llm import jaccard, sketch
from auditspan.session import checkpoint_dir
from tests.llm.conftest import prose
from tests.llm.test_text_operators import bag, brute_classes


@pytest.fixture
def written(spark):
    """Bytes of tables that have come to the scratch folder since the test began."""
    top = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(top.glob("*"))
    return lambda: sum(p.stat().st_size for d in set(top.glob("*")) - before for p in d.rglob("*.parquet"))


def full_sketch(monkeypatch, bits=12):
    monkeypatch.setattr(sketch, "MOST_BITS", bits)
    monkeypatch.setattr(jaccard, "MOST_BITS", bits, raising=False)


def table_of(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(2)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_more_shingles_than_cells(spark, written, monkeypatch, width, percent):
    full_sketch(monkeypatch)
    texts = [(i, prose(100 + i, 600)) for i in range(240)]
    texts += [(1000 + i, t + " changed end") for i, t in texts[:10]] + [(2000 + i, t) for i, t in texts[5:15]]
    texts += [(None, texts[3][1]), (3000, "one two"), (3001, "ONE two"), (3002, ""), (3003, None)]
    found = jaccard.near_duplicate_classes(table_of(spark, texts), width=width, percent=percent).collect()
    assert bag(found) == brute_classes(texts, width, percent)
    # the sets of all texts, eight bytes a shingle, are more than the texts
    assert written() < 0.5 * sum(len(t or "") for _, t in texts)


def test_repeated_texts_are_counted_once(spark, written):
    texts = [(1000 * k + i, prose(500 + i, 600)) for i in range(40) for k in range(12)]
    found = jaccard.near_duplicate_classes(table_of(spark, texts)).collect()
    assert bag((r.doc_id, r.component_id) for r in found) == Counter((i, i % 1000) for i, _ in texts)
    assert written() < 0.1 * sum(len(t) for _, t in texts)


@pytest.mark.parametrize("bits", [12, 28])
def test_sizes_far_apart_in_one_list(spark, monkeypatch, bits):
    full_sketch(monkeypatch, bits)
    words = prose(77, 400).split()
    texts = [(500 - n, " ".join(words[:n])) for n in [*range(1, 30), *range(40, 120, 5), 200, 230, 300, 340, 380, 400]]
    texts += [(600 + n, " ".join(words[:n]).upper()) for n in (3, 45, 230)]
    found = jaccard.near_duplicate_classes(table_of(spark, texts)).collect()
    assert bag(found) == brute_classes(texts, 3, 90)


def test_folded_table_counts_no_less(spark):
    values = np.random.default_rng(3).integers(0, 2**63, 300, dtype=np.uint64)
    rows = spark.createDataFrame([(int(v),) for i, v in enumerate(values.tolist()) for _ in range(1 + i % 6)], "v long")
    made = sketch.merged_sketch(rows.repartition(3), lambda b: iter([b.column("v").to_numpy().view(np.uint64)]), bits=18,
                                lines=2, thresholds=(1, 2, 4), folds=(0, 1, 3))
    assert [[len(t) for t in line] for line in made.tables] == [[1 << 15, 1 << 14, 1 << 12]] * 2
    times = 1 + np.arange(300) % 6
    for which, least in enumerate((1, 2, 4)):
        reached = made.at_least(values, which)
        assert reached[times >= least].all() and reached[times < least].sum() <= 10
    assert rows.agg(F.count("v")).first()[0] == times.sum()


def test_near_copies_of_the_pipeline_with_a_full_sketch(spark, written, monkeypatch, tmp_path):
    import corpus_pipeline as pipeline
    full_sketch(monkeypatch)
    texts = [(i, prose(900 + i, 600)) for i in range(120)]
    copies = [(1000 + i, t + " changed end") for i, t in texts[:10]] + [(2000 + i, t) for i, t in texts[5:15]] + [texts[7]]
    other = [(7, prose(1100, 50)), (None, texts[3][1]), (None, prose(1101, 50)), (3000, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts + copies + other],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    left = pipeline.ngram_jaccard_join(spark, docs, str(tmp_path))
    assert bag((r.doc_id, r.text) for r in left.collect()) == Counter([*texts, other[0], other[2], other[3]])
    assert written() < 0.5 * sum(len(t or "") for _, t in texts + copies)


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_a_part_never_rules_out_a_link(percent):
    """Classes by a part of each set, with ends that are equal by chance, hold the classes by whole sets together."""
    r = np.random.default_rng(percent)
    base = np.unique(r.integers(0, 2**63, 90, dtype=np.uint64))
    base[1::7] = base[0:len(base[1::7]) * 7:7] + np.uint64(2**40)
    sets = [np.unique(np.concatenate([base[r.random(len(base)) > d], r.integers(0, 2**63, e, dtype=np.uint64)]))
            for d in (0, 0.02, 0.05, 0.1, 0.3) for e in (0, 1, 3, 9) for _ in range(3)]
    for some in (sets, sets[:2], sets[5:7]):
        sizes = np.array([len(s) for s in some])
        parts = [jaccard.short(s[:np.searchsorted(s, np.uint64(2**61))]) for s in some]
        whole = jaccard.linked_roots(some, sizes, percent)
        part = jaccard.linked_roots(parts, sizes, percent, sizes - [len(p) for p in parts])
        assert (part == part[whole]).all()
