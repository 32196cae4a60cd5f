"""Operators 11 to 13 on rows with nulls, empty and very long texts, ties and repeated rows, against brute force."""
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditspan.llm import divergence, exact_dedup, fill_middle, queries
from tests.llm.conftest import prose


def bag(rows):
    return Counter(tuple(r) for r in rows)


# 11 exact dedup

def expected_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = Counter()
    for content, members in groups.items():
        order = sorted(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] if m[0] is not None else 0))
        for place, (i, _) in enumerate(order):
            out[i, order[0][0], len(members), place == 0, hashlib.sha256(content.encode()).hexdigest()] += 1
    return out


def found_groups(docs, **options):
    made = exact_dedup.duplicates(docs, **options)
    return made.select("doc_id", "keep_id", "group_size", "kept", "digest")


COPIES = [(1, "a b c"), (2, "abc"), (3, "a  b c"), (4, "\ta\x0bb\x0cc\r\n"), (5, "ab c "), (7, None), (6, ""), (8, " \n"),
          (9, "a b"), (10, "a b"), (11, "é x"), (12, "ж 😀"), (13, "ж😀 "), (-3, "twin"), (-3, "twin"),
          (-3, "twin"), (-4, "t win"), (None, "twin "), (None, "twin "), (None, "only"), (2**62, "far"),
          (-2**63, "f ar"), (2**63 - 1, "fa r"), (20, "x" * 900_000), (21, "x " + "x" * 899_999)]


def test_exact_dedup_equals_brute_force(spark, tricky, texts, none):
    made = found_groups(tricky).withColumn("digest", F.lower(F.hex("digest")))
    assert bag(made.collect()) == expected_groups(texts)
    docs = spark.createDataFrame([(i, t, 5, "d", "s") for i, t in COPIES],
                                 "doc_id long, text string, n int, digest string, salt string")
    for parts in (1, 7):
        made = found_groups(docs.repartition(parts)).withColumn("digest", F.lower(F.hex("digest")))
        assert bag(made.collect()) == expected_groups(COPIES)
    assert exact_dedup.duplicates(none).count() == 0


def test_exact_dedup_compares_contents_where_digests_are_equal(spark):
    """A digest of two bits holds many contents; the result stays the same."""
    rows = COPIES + [(100 + i, prose(i % 40, 6)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)

    def two_bits(content):
        return F.substring(F.hex(F.pmod(F.xxhash64(content), F.lit(4))), 1, 1).cast("binary")

    made = found_groups(docs, digest=two_bits).drop("digest")
    assert bag(made.collect()) == Counter({k[:4]: n for k, n in _without_digest(expected_groups(rows)).items()})


def _without_digest(found):
    out = Counter()
    for key, n in found.items():
        out[key[:4]] += n
    return out


def test_exact_dedup_takes_ids_of_any_kind_and_a_large_group(spark):
    rows = [(f"id{i % 97:02d}", "same  text" if i % 3 else f"text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(11)
    assert bag(found_groups(docs).drop("digest").collect()) == _without_digest(expected_groups(rows))
    assert exact_dedup.duplicates(docs).filter("kept").count() == 301


def test_exact_dedup_moves_no_text_with_the_rows(spark, tricky):
    from contextlib import redirect_stdout
    from io import StringIO
    out = StringIO()
    with redirect_stdout(out):
        exact_dedup.duplicates(tricky).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
    assert all("content" not in line for line in out.getvalue().splitlines() if "Exchange" in line)


# 12 fill in middle

def expected_rewrite(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


MARKED = ["a <P> b", "<S>", "x<M", "<<P<S<M>>", "<", ">S>", "<P<P", "é😀ж" * 30, "\x00\n\r ", "<p><s><m>", "S>" * 40 + "<" * 40]


def test_rewriting_equals_brute_force_and_is_undone(spark, tricky, texts, none):
    rows = texts + [(i, MARKED[i % len(MARKED)]) for i in range(1000, 1400)]
    docs = spark.createDataFrame([(i, t, 1, "f", "o") for i, t in rows],
                                 "doc_id long, text string, n int, form string, output string")
    made = fill_middle.rewritten(docs)
    assert bag(made.collect()) == bag(expected_rewrite(i, t) for i, t in rows)
    back = made.select("doc_id", fill_middle.restored().alias("text")).collect()
    assert bag(back) == bag((i, t or "") for i, t in rows)
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_middle.rewritten(none).count() == 0
    assert fill_middle.rewritten(tricky).count() == len(texts)


@pytest.mark.parametrize("units", [0, 1, 31, 32, 33, 255, 256, 257, 5000])
def test_skip_list_reaches_every_rank(units):
    lengths = np.random.default_rng(units).integers(1, 9, units)
    made = fill_middle.SkipList(lengths)
    before = np.concatenate([[0], np.cumsum(lengths)])
    assert [made.code_point(r) for r in range(units + 1)] == before.tolist()
    assert all(int(u.sum()) == units and int(p.sum()) == before[-1] for u, p in made.lanes)


def test_rewriting_by_words_keeps_words_whole(spark):
    rows = [(i, prose(i, i % 50)) for i in range(300)]
    made = fill_middle.rewritten(spark.createDataFrame(rows, "doc_id long, text string"), unit=r"\S+\s*", plain_percent=0)
    for r in made.withColumn("back", fill_middle.restored()).collect():
        text = dict(rows)[r.doc_id]
        assert r.n == len(text.split()) and r.back == text
        if r.form != "plain":
            cuts = (r.prefix_chars, r.prefix_chars + r.middle_chars)
            assert all(c in (0, len(text)) or text[c - 1] == " " for c in cuts)


# 13 source divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, least=10, top=10):
    rows = [tuple(v or "" for v in r) for r in rows]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        total = Counter()
        for s in sources:
            total.update({t: n for t, n in counts[lang, s].items() if t in kept})

        def shares(count):
            size = sum(count[t] for t in kept)
            return {t: 1 + (10**9 * (count[t] + 2)) // (size + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(total)

        def far(a, b):
            return (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(far(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (value, item) in enumerate(order[:most])]
    return Counter(out)


def texts_by_source(seed, n):
    r = np.random.default_rng(seed)
    words = ["a", "Ab", "abcdefgh", "abcdefghi", "ABCDEFGHIJKLMNOP", "abcdefghijklmnopq", "straße", "ünïcödé" * 3, "жук",
             "x" * 40, "x" * 41, "日本語の文", "don't", "re-do", "É", "é", "z" * 16, "z" * 17, "😀"]
    rows = []
    for i in range(n):
        picked = r.choice(len(words), r.integers(0, 30))
        rows.append((" ".join(words[k] for k in picked), ["en", "de", None, ""][r.integers(4)], ["s1", "s2", "s3", None][r.integers(4)]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string")


def test_divergence_equals_brute_force(spark, none):
    rows = texts_by_source(5, 400) + [(None, "xx", "lonely"), ("1 2 3", "xx", "other"), ("word " * 200_000, "en", "s1"),
                                      ("y" * 1_200_000, "en", "s9"), ("A" * 20 + "[" + "a" * 20, "en", None)] * 2
    assert bag(divergence.audit(frame(spark, rows).repartition(3)).collect()) == brute_audit(rows)
    assert divergence.audit(none).count() == 0


def test_divergence_over_many_blocks_and_buckets(spark, monkeypatch):
    """Units of work are only a division: few sources a block and many buckets give the same."""
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "UNIT_ROWS", 5)
    monkeypatch.setattr(divergence, "CELLS", 3)
    rows = [(t, "en", f"s{i % 9}") for i, (t, _, _) in enumerate(texts_by_source(6, 120))]
    assert bag(divergence.audit(frame(spark, rows), least_docs=3, top_terms=2).collect()) == brute_audit(rows, 3, 2)


def test_terms_are_counted_by_packed_words():
    texts = ["Aa aa b", "", "aa " + "q" * 9 + " " + "q" * 16 + " " + "q" * 17, "b" * 8 + "," + "B" * 8 + " é", "aa"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found = Counter()
    for terms, group, n, docs in divergence.count_terms(np.frombuffer(data, np.uint8), offsets, np.array([0, 0, 1, 1, 0])):
        for row in zip(terms.to_pylist(), group.tolist(), n.tolist(), docs.tolist()):
            found[row] += 1
    assert found == Counter([("aa", 0, 3, 2), ("b", 0, 1, 1), ("aa", 1, 1, 1), ("q" * 9, 1, 1, 1), ("q" * 16, 1, 1, 1),
                             ("q" * 17, 1, 1, 1), ("b" * 8, 1, 2, 1), ("é", 1, 1, 1)])


def test_radix_order_is_the_order_of_the_words():
    r = np.random.default_rng(2)
    high, low = r.integers(0, 3, 5000).astype(np.uint64) << np.uint64(62), r.integers(0, 2**63, 5000).astype(np.uint64)
    order = divergence.radix_order([high, low], np.arange(5000))
    assert order.tolist() == np.lexsort((low, high)).tolist()
    assert pa.array(order).null_count == 0


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_fill_in_middle", "op13_source_divergence"])
def test_queries_have_the_contract_columns(spark, name):
    columns = {"op11_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
               "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
               "op13_source_divergence": ["lang", "source", "part", "item", "value", "rank"]}
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns[name]
