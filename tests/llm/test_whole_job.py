"""Cases that bounded seeds, samples of features and capped patterns would miss, against brute force."""
import math
import random
import re
import time
from itertools import combinations

import numpy as np
import pytest

from auditspan.llm import decontamination, secrets, substrings, toxicity
from tests.llm.conftest import prose


# 2 decontamination

@pytest.mark.parametrize("length", range(1, 16))
def test_every_accepted_pattern_holds_a_masked_span(length):
    most = length - math.ceil(decontamination.SIMILARITY * length)
    masks = decontamination.lossless_masks(length, most)
    spans = [{at + o for o in m} for m in masks for at in range(length - m[-1])]
    for wrong in combinations(range(length), most):
        assert any(not span & set(wrong) for span in spans), wrong


def brute_overlaps(docs, items, window=15, share=0.8):
    """Best alignment of every pair without seeds: (doc_start, window_words, matched_words)."""
    out = {}
    for d, text in docs:
        a = text.split()
        for i, item in items:
            b = item.split()
            n = min(window, len(b))
            best = max(((sum(x == y for x, y in zip(a[p:p + n], b[q:q + n])), -p)
                        for p in range(len(a) - n + 1) for q in range(len(b) - n + 1)), default=(0, 0))
            if n and best[0] >= math.ceil(share * n):
                out[d, i] = (-best[1], n, best[0])
    return out


def test_decontamination_equals_alignment_without_seeds(spark, monkeypatch):
    r = random.Random(4)
    items = [(n, prose(400 + n, n)) for n in (*range(1, 18), 20, 26)]
    docs = []
    for i, item in items:
        for _ in range(12):
            w = item.split()
            for at in r.sample(range(len(w)), min(len(w), r.randrange(0, 5))):
                w[at] = f"new{r.randrange(10 ** 6)}"
            docs.append((len(docs), " ".join([prose(r.random(), r.choice([0, 3, 250])), *w, prose(r.random(), 4)])))
    # words 4, 8 and 12 of 15, and the first of 10
    w = items[14][1].split()
    docs.append((len(docs), " ".join("x" if k in (3, 7, 11) else v for k, v in enumerate(w))))
    docs.append((len(docs), " ".join(["x", *items[9][1].split()[1:]])))
    want = brute_overlaps(docs, items)
    assert (len(docs) - 2, 15) in want and (len(docs) - 1, 10) in want
    tables = (spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
              spark.createDataFrame(items, "item_id long, text string"))
    for most in (decontamination.MAX_BROADCAST_SEEDS, 0):
        monkeypatch.setattr(decontamination, "MAX_BROADCAST_SEEDS", most)
        found = {(x.doc_id, x.item_id): (x.doc_start, x.window_words, x.matched_words)
                 for x in decontamination.contaminated(*tables).collect()}
        assert found == want


# 5 toxicity

def test_whole_toxic_texts_enter_the_fit(spark):
    r = random.Random(8)

    def text(toxic):
        noise = [f"w{r.randrange(10 ** 9)}" for _ in range(700)]
        return " ".join(noise + ["grumbler snarling at the knave", "you blithering scoundrel"] * toxic)
    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(150)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(5)] + [(rows[5][0], rows[5][1], 1), (2000, None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic").distinct())

    texts = [(t.encode(), y) for _, t, y in rows if t is not None]
    confirmed = {s.tobytes(): s for s in (toxicity.feature_set(t) for t, y in texts if y)}.values()
    assert min(map(len, confirmed)) > 12_000
    seen, n = np.unique(np.concatenate(list(confirmed)), return_counts=True)
    seen, n = seen[n >= 3], n[n >= 3]
    found = np.concatenate([toxicity.feature_set(t) for t, _ in texts])
    held = np.array([(found == f).sum() for f in seen])
    low = (held + 0.5) / (len(texts) + 1)
    telling = (n / len(confirmed) - low) / np.sqrt(low * (1 - low) / len(confirmed)) >= toxicity.MIN_SCORE
    assert telling.sum() > 50 and model.features.tolist() == seen[telling].tolist()


# 10 secrets

def test_url_credentials_of_any_length(spark):
    r = random.Random(6)

    def value(n):
        return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123456789-_.") for _ in range(n))
    rows = []
    for user, n in [("u", 256), ("u", 257), ("u", 5000), ("u" * 64, 40), ("u" * 65, 40), ("u" * 900, 900), ("", 40),
                    ("a%40b.c", 40), ("a+b", 40)]:
        v = value(n)
        start = len(f"git clone https://{user}:")
        rows.append((len(rows), f"git clone https://{user}:{v}@host/x y", f"{start}:{start + n}", v))
    rows.append((len(rows), "x://://u:Zx81k@Qpw92Lm@h", "9:22", "Zx81k@Qpw92Lm"))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    found = {x.doc_id: x for x in secrets.scan(docs).collect()}
    for i, text, span, v in rows:
        assert f"guess:{span}" in found[i].spans.split(","), text[:90]
        assert v not in found[i].redacted
    kept = {x.doc_id: x.text for x in secrets.redact(docs).collect()}
    assert all(v not in kept[i] for i, _, _, v in rows)


def test_url_values_equal_brute_force_and_take_linear_time():
    r = random.Random(7)
    for _ in range(3000):
        text = "".join(r.choice([":", "/", "@", "a", " ", "://", "secret", "\n", "é"]) for _ in range(25))
        want = []
        for at in range(len(text)):
            if text.startswith("://", at):
                part = re.split(r"[/ \t\n\r\f\v]", text[at + 3:])[0]
                front, sign, _ = part.rpartition("@")
                user, colon, v = front.partition(":")
                if sign and colon and len(v) >= 6:
                    want.append((at + 4 + len(user), at + 4 + len(user) + len(v)))
        assert list(secrets.url_values(text)) == want, text
    began = time.process_time()
    for text in ("://" * 400_000, "://a:" * 300_000, "://" + "a" * 1_000_000, "://" + "a:" * 500_000 + "/",
                 "://" + "@" * 1_000_000 + ":"):
        assert not any(True for s, e in secrets.url_values(text))
    assert time.process_time() - began < 10


# pipeline

def test_decisions_of_the_pipeline_hold_for_id_and_text(spark, tmp_path):
    import corpus_pipeline as pipeline
    a, b, c, d, e = (prose(800 + i, 60) for i in range(5))
    near = a + " end"
    rows = [(1, a), (1, a), (1, a), (2, near), (3, b), (3, a), (None, a), (None, c), (None, c), (None, d), (4, None),
            (4, None), (5, ""), (None, None), (6, e), (6, e)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = pipeline.ngram_jaccard_join(spark, docs, str(tmp_path))
    assert left.columns == list(pipeline.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        [(1, a), (3, b), (None, c), (None, d), (4, None), (4, None), (5, ""), (None, None), (6, e)], key=repr)
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=repr) == sorted(
        [r for r in rows if r[1] not in (a, near)], key=repr)


# 4 substring dedup

def test_starts_of_repeated_rows_are_gathered_once(spark):
    """n equal rows have the same starts; each is named once, not once for every row."""
    text = prose(9, 135)
    docs = spark.createDataFrame([(1, text)] * 400 + [(i, text) for i in range(2, 50)], "doc_id long, text string").repartition(7)
    found = substrings.repeated_windows(docs, 35).collect()
    assert {r.doc_id: sorted(r.starts) for r in found} == {i: list(range(101)) for i in range(1, 50)}
    made = substrings.deduplicated(docs, with_text=False).select("n_words", "n_removed").distinct().collect()
    assert [tuple(r) for r in made] == [(135, 135)]
