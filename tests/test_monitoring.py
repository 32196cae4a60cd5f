import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from auditspan import schemas
from auditspan.functions import diffs, replies
from auditspan.knowledge import fixed_values as fixed
from auditspan.localtable import local_table
from auditspan.operators import digest, monitoring
from auditspan.streaming import jobs

T0 = datetime(2025, 1, 1)


def fetches(spark, rows):
    data = [(i, s, u, t, st, T0 + timedelta(hours=h)) for i, (s, u, t, st, h) in enumerate(rows)]
    return monitoring.snapshot_rows(spark.createDataFrame(
        data, "id bigint, source_id string, url string, text string, fetch_status string, captured_at timestamp"))


def reference_history(rows):
    """Plain loop over one ordered list: the definition the windows must meet."""
    last, good, out = {}, {}, {}
    for i, (s, u, t, st, _) in enumerate(rows):
        key = (s, u)
        text = t if st == "ok" else ""
        out[i] = (key in last, last.get(key), good.get(key, [])[:3])
        last[key] = text
        if st == "ok":
            good[key] = [sum(1 for x in text.split("\n") if x.strip()), *good.get(key, [])][:3]
    return out


def test_history_across_buckets_equals_the_loop(spark):
    rng = random.Random(7)
    rows = [(f"s{rng.randint(0, 2) % 2}", f"u{rng.randint(0, 1)}", rng.choice(["", "a", "a\nb", "c\n\nd\ne"]),
             rng.choice(["ok", "ok", "error"]), h // 3) for h in range(400)]
    for bucket in ("hour", "day", "year"):
        table = fetches(spark, rows)
        got = monitoring.with_texts(monitoring.snapshot_history(table, bucket), table).collect()
        seen = {r.id: (r.has_previous, r.previous_text, list(r.recent_items)) for r in got}
        assert seen == reference_history(rows)


def test_snapshot_rows(spark):
    rows = fetches(spark, [("s", "u", "x" * 20000, "ok", 0), ("s", "u", "y", "blocked", 1)]).orderBy("id").collect()
    assert len(rows[0].raw_text) == 20000 and len(rows[0].content_hash) == 64
    assert (rows[1].raw_text, rows[1].content_hash, rows[1].fetch_status) == ("", "", "blocked")


def test_parse_warning(spark):
    good, empty = ("s", "u", "a", "ok"), ("s", "u", "", "ok")
    def warned(rows):
        history = monitoring.snapshot_history(fetches(spark, [(*r, i) for i, r in enumerate(rows)]))
        return [r.id for r in monitoring.parse_warnings(history).collect()]
    assert warned([good, good, good, ("s", "u", "", "error")]) == [3]
    assert warned([empty, empty, empty, empty]) == []
    assert warned([good, good, empty]) == []


def diff_of(spark, *pairs, cut=diffs.with_snapshot_diff):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, o string, n string")
    return [r.d for r in cut(rows, "o", "n", "d").orderBy("i").collect()]


def test_diff(spark):
    text, same, none, first, last, gone = diff_of(
        spark, ("Line 1\nLine 2\nLine 3\n", "Line 1\nLine 2 modified\nLine 3\nLine 4 added\n"), ("a\nb", "a\nb"), (None, "x"),
        ("", "new"), ("a", "a\n"), ("x\ny\n", ""))
    assert text == "--- +++ @@ -1,3 +1,4 @@ Line 1\n-Line 2\n+Line 2 modified\n Line 3\n+Line 4 added\n"
    assert same == "" and none is None and first == "--- +++ @@ -0,0 +1 @@+new"
    assert last == "--- +++ @@ -1 +1 @@-a+a\n" and gone == "--- +++ @@ -1,2 +0,0 @@-x\n-y\n"


def random_lines(rng):
    lines = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 14))]
    changed = list(lines)
    for _ in range(rng.randint(0, 4)):
        at = rng.randint(0, len(changed))
        kind = rng.random()
        if kind < 0.4 or not changed:
            changed.insert(at, rng.choice("abcxyz"))
        elif kind < 0.7:
            changed.pop(min(at, len(changed) - 1))
        else:  # a move
            changed.insert(at, changed.pop(rng.randrange(len(changed))))
    return lines, changed


def test_hunks_lead_from_the_old_lines_to_the_new():
    rng = random.Random(11)
    for _ in range(1500):
        old, new = random_lines(rng)
        kept = diffs.kept_lines(old, new)
        assert all(old[i] == new[j] for i, j in kept)
        assert all(a < c and b < d for (a, b), (c, d) in zip(kept, kept[1:]))
        for context in (0, 2, 3):
            made, at = [], 0
            for h in diffs.hunks_of(old, new, context):
                first = h["old_first"]
                made += old[at:first]
                assert len(made) == h["new_first"]
                for line in h["lines"]:
                    made += [] if line["kind"] == diffs.REMOVED else [new[line["at"]] if line["kind"] == diffs.ADDED else old[line["at"]]]
                at = first + h["old_lines"]
                assert sum(x["kind"] != diffs.REMOVED for x in h["lines"]) == h["new_lines"]
                assert all(x["kind"] != diffs.KEPT for x in h["lines"]) or context
            assert made + old[at:] == new


def test_the_longest_rising_run_of_pairs_stays():
    from itertools import combinations
    rng = random.Random(12)
    for _ in range(200):
        old = rng.sample(range(9), rng.randint(0, 7))
        new = rng.sample(range(9), rng.randint(0, 7))
        pairs = [(i, new.index(x)) for i, x in enumerate(old) if x in new]
        best = max((len(c) for n in range(len(pairs) + 1) for c in combinations(pairs, n)
                    if all(a[1] < b[1] for a, b in zip(c, c[1:]))), default=0)
        assert len(diffs.kept_lines(old, new)) == best


def test_single_changes_equal_the_usual_unified_diff(spark):
    import difflib
    rng = random.Random(13)
    pairs = []
    for _ in range(60):
        old = [f"line {i}\n" for i in range(rng.randint(0, 30))]
        new = list(old)
        for at in sorted(rng.sample(range(len(old) + 1), min(len(old), rng.randint(0, 4))), reverse=True):
            new[at:at + rng.randint(0, 1)] = [f"other {at}\n"]
        pairs.append((old, new))
    for cut, context in ((diffs.with_snapshot_diff, 2), (diffs.with_document_diff, 3)):
        labels = ("", "") if context == 2 else fixed.DIFF_LABELS
        got = diff_of(spark, *[("".join(o), "".join(n)) for o, n in pairs], cut=cut)
        assert got == ["".join(difflib.unified_diff(o, n, *labels, lineterm="", n=context)) for o, n in pairs]


def test_diffs_of_long_texts_take_n_log_n_steps():
    rng = random.Random(14)
    lines = list(range(60_000))
    moved = lines[:]
    rng.shuffle(moved)
    started = time.perf_counter()
    diffs.hunks_of(lines, moved, 2)
    diffs.hunks_of([0] * 60_000, [1, *[0] * 59_000, 2], 2)
    assert time.perf_counter() - started < 5


def test_classes(spark):
    cases = {"контакты": "minor", "Цена 100": "pricing", "добавили функцию, цена": "pricing",
             "новая проверка": "feature", "НОВЫЙ вид": "ui", "100 руб": "minor"}
    rows = spark.createDataFrame([(k,) for k in cases], "d string").select("d", diffs.change_class(F.col("d")).alias("c")).collect()
    assert {r.d: r.c for r in rows} == cases


def json_of(spark, *texts):
    table = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    return [r.json for r in replies.with_json(table).orderBy("i").collect()]


def test_json_in_replies(spark):
    assert json_of(spark, "[1]", "```json\n[1]\n```", "[]", "нет", "вот [1] и всё", 'x {"a": [1]} y', "```\n{}```", "", "[1, {") == [
        "[1]", "[1]", "[]", None, "[1]", "[1]", "{}", None, None]


def test_analysis_normalisation(spark):
    texts = ['{"threat_score": 9}', '{"threat_score": "4", "change_type": "npa"}', '{"threat_score": 3.9, "action_required": "no"}',
             '{"threat_score": "4.5", "summary": 5}', "[1]", '{"threat_score": null, "change_type": "x", "action_required": 1}']
    table = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    got = [r.a for r in replies.with_json(table).orderBy("i").select(replies.analysis(F.col("doc")).alias("a")).collect()]
    assert [(a.threat_score, a.change_type, a.action_required) if a else None for a in got] == [
        (5, "ui", False), (4, "npa", False), (3, "ui", True), (3, "ui", False), None, (3, "ui", True)]
    assert got[3].summary == "5"


def changes(spark, *rows):
    data = [(i, "s", "u", None, kind, score, critical, T0 + timedelta(hours=i)) for i, (kind, score, critical) in enumerate(rows)]
    return local_table(spark, data, schemas.CHANGES)


def test_digest_order_and_text(spark):
    table = changes(spark, ("npa", 5, False), ("ui", None, None), ("npa", 2, True), ("pricing", 4, None))
    row = digest.digest_text(table, F.lit("01.01.2025")).first()
    text = row.content_md
    assert row.max_score == 5 and text.index("КРИТИЧНО*") < text.index("КРИТИЧНО (5/5)_")
    assert text.index("цены") < text.index("интерфейс") and "❓ не определён" in text and not text.endswith("\n")
    assert digest.digest_text(changes(spark), F.lit("d")).count() == 0
    only = digest.digest_text(changes(spark, ("ui", 1, None)), F.lit("d")).first().content_md
    assert "нормативные изменения*\n\n_нет изменений за период_\n\n" + "─" * 24 in only


def test_pending_split_is_null_safe(spark):
    table = changes(spark, ("npa", 1, None), ("ui", 2, True), ("ui", 3, None), ("ui", None, False))
    digested = spark.createDataFrame([(2,)], "change_id bigint")
    pending = digest.pending_changes(table, digested, 100)
    assert [r.id for r in pending.collect()] == [1, 0, 3]
    law, rest = digest.split_pending(pending)
    assert {r.id for r in law.collect()} == {0, 1} and {r.id for r in rest.collect()} == {3}


def test_legal_change_without_analysis_keeps_no_score(spark):
    sources = spark.createDataFrame([("s", "Источник", ["слово"], True)], "source_id string, name string, keywords array<string>, npa_critical boolean")
    table = fetches(spark, [("s", "u", "a", "ok", 0), ("s", "u", "штраф", "ok", 1)])
    diffed = monitoring.with_diff(monitoring.changed_snapshots(monitoring.snapshot_history(table), table))
    none = spark.createDataFrame([], "id bigint, reply string")
    row = monitoring.legal_changes(diffed, sources, none).first()
    assert (row.change_type, row.threat_score, row.npa_critical) == ("npa", None, None)
    reply = spark.createDataFrame([(1, '{"summary": "важно", "threat_score": 5, "action_required": true, "action": "делать"}')], "id bigint, reply string")
    alerts = monitoring.critical_alerts(monitoring.legal_changes(diffed, sources, reply)).select(digest.alert_text().alias("m")).collect()
    assert len(alerts) == 1 and "🔴 КРИТИЧНО" in alerts[0].m and alerts[0].m.endswith("*Требуемые действия:*\nделать")


def test_stream_state_spans_batches_and_reports_late_rows(spark, tmp_path):
    first = [("s", "u", "a", "ok", 0), ("s", "u", "b", "ok", 1), ("s", "u", "", "error", 2)]
    second = [("s", "u", "b", "ok", 3), ("s", "u", "b", "ok", 4), ("s", "u", "z", "ok", 1)]
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for part in (first, second):
        base = len(first) if part is second else 0
        fetches(spark, part).withColumn("id", F.col("id") + base).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schemas.SNAPSHOTS).parquet(src)
        q = (jobs.snapshot_changes(stream).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", progress).trigger(availableNow=True).start())
        q.awaitTermination()
    got = {r.id: r.route for r in spark.read.parquet(out).collect()}
    assert got == {0: "baseline", 1: "changed", 2: "failed", 3: "changed", 4: "unchanged", 5: "late"}
