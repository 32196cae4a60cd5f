"""Streams over several micro-batches against the batch definitions and brute force."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditspan import schemas
from auditspan.functions import replies
from auditspan.operators import digest, monitoring
from auditspan.streaming import jobs

T0 = datetime(2025, 3, 3, 10)  # a Monday, where a digest period begins


def rows_of(spark, rows):
    """(id, url, text, status, minutes or None) as snapshots."""
    data = [(i, "s", url, text, status, None if at is None else T0 + timedelta(minutes=at)) for i, url, text, status, at in rows]
    return monitoring.snapshot_rows(spark.createDataFrame(
        data, "id long, source_id string, url string, text string, fetch_status string, captured_at timestamp"))


def drain(spark, tmp_path, batches, delay, restart=False):
    """Routes of snapshots that arrive in ``batches``; with ``restart`` every batch is a run of its own."""
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        stream = spark.readStream.schema(schemas.SNAPSHOTS).option("maxFilesPerTrigger", 1).parquet(src)
        q = (jobs.snapshot_changes(stream, delay).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", progress).trigger(availableNow=True).start())
        q.awaitTermination()

    for rows in batches:
        rows_of(spark, rows).coalesce(1).write.mode("append").parquet(src)
        if restart:
            run()
    if not restart:
        run()
    return spark.read.parquet(out).collect()


def expected(batches, delay, restart):
    """Routes by the definition: sorted release up to the newest time less ``delay`` minutes.

    The watermark of a batch is that of the batch before; a run ends with one more step.
    """
    released, waiting, out, mark, state = {}, {}, [], None, {}

    def release():
        for url in list(waiting):
            due = sorted(r for r in waiting[url] if mark is not None and r[0] <= mark)
            waiting[url] = [r for r in waiting[url] if mark is None or r[0] > mark]
            for at, i, text, status in due:
                known, recent = state.get(url, (None, []))
                items = len([x for x in text.split("\n") if x.strip()]) if status == "ok" else 0
                warning = items == 0 and len(recent) == 3 and min(recent) > 0
                body = text if status == "ok" else ""
                # a failed fetch has no hash, which differs from that of an empty text
                now = (status == "ok", body)
                route = "failed" if status != "ok" else "baseline" if known is None else "unchanged" if known == now else "changed"
                out.append((i, route, None if known is None else known[1], warning))
                state[url] = (now, ([items, *recent] if status == "ok" else recent)[:3])
                released[url] = (at, i)

    newest = None
    for number, rows in enumerate(batches):
        for i, url, text, status, at in rows:
            if at is None or (url in released and (at, i) < released[url]):
                out.append((i, "late", None, False))
            else:
                waiting.setdefault(url, []).append((at, i, text, status))
        release()
        times = [r[4] for r in rows if r[4] is not None]
        newest = max([*times, *([newest] if newest is not None else [])], default=None)
        mark = None if newest is None else newest - delay
        if restart or number == len(batches) - 1:
            release()
    return out


def random_batches(seed, hot):
    r = random.Random(seed)
    batches, i = [], 0
    for b in range(5):
        rows = []
        for _ in range(30):
            url = "hot" if r.random() < hot else f"u{r.randrange(4)}"
            at = None if r.random() < 0.03 else b * 100 + r.randrange(-150, 150)
            rows.append((i, url, r.choice(["a", "a\nb", "", "c"]), "error" if r.random() < 0.15 else "ok", at))
            i += 1
        batches.append(rows)
    batches[-1].append(batches[0][0])  # a repeated row, very late or waiting again
    return batches


@pytest.mark.parametrize("restart, delay", [(False, 0), (False, 120), (True, 120)])
def test_snapshots_are_put_in_order_within_the_delay(spark, tmp_path, restart, delay):
    batches = random_batches(delay + restart, 0.4)
    got = drain(spark, tmp_path, batches, f"{delay} minutes", restart)
    want = expected(batches, delay, restart)
    assert sorted((r.id, r.route, r.previous_text if r.route != "late" else None, r.parse_warning) for r in got) == sorted(
        want, key=lambda x: x[:2])
    assert any(r[1] == "late" for r in want) and any(r[1] == "changed" for r in want)


def test_one_page_may_hold_most_rows(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"u{i % 7}", f"t{i % 2}", "ok", i) for i in range(1500)]
    r = random.Random(1)
    batches = []
    for first in range(0, 1500, 500):
        part = rows[first:first + 500]
        r.shuffle(part)
        batches.append(part)
    got = drain(spark, tmp_path, batches, "0 minutes")
    assert sorted(x.id for x in got) == list(range(1500)) and {x.route for x in got} == {"baseline", "changed", "unchanged"}
    hot = sorted((x.captured_at, x.id, x.previous_text, x.raw_text) for x in got if x.url == "hot")
    assert all(b[2] == a[3] for a, b in zip(hot, hot[1:]))


def test_stored_updates_never_come_out(spark, tmp_path):
    def found(rows):
        return spark.createDataFrame([(s, t, None if at is None else T0 + timedelta(minutes=at)) for s, t, at in rows],
                                     "source string, title string, found_at timestamp")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", "x", 5), ("a", "y", None), ("a", "x", 1), (None, "z", 2)], [("a", "x", 0), ("b", "x", 3), ("k", "old", 4)],
                 [("k", "old", 5), ("a", "y", 1), ("c", None, None)]):
        found(rows).coalesce(1).write.mode("append").parquet(src)
    known = spark.createDataFrame([("k", "old"), ("k", "old"), ("never", "seen")], "source string, title string").select(
        replies.content_key(F.col("source"), F.col("title")).alias("content_key"))
    stream = spark.readStream.schema("source string, title string, found_at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = (jobs.new_updates(stream, "found_at", known).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = [(r.source, r.title, r.found_at) for r in spark.read.parquet(out).collect()]
    minute = timedelta(minutes=1)
    assert sorted(got, key=repr) == sorted([("a", "x", T0 + minute), ("a", "y", None), (None, "z", T0 + 2 * minute),
                                            ("b", "x", T0 + 3 * minute), ("c", None, None)], key=repr)


def test_weekly_digest_is_the_text_of_the_best_changes(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, f"s{i % 3}", f"https://e.com/{i}", None if i % 4 == 0 else f"text {i}", r.choice(["npa", "ui", "pricing"]),
             r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, True, False]), T0 + timedelta(hours=r.randrange(0, 24 * 20)))
            for i in range(240)]
    rows.sort(key=lambda x: x[-1])
    schema = ("id long, source_id string, url string, diff_summary string, change_type string, threat_score int, "
              "npa_critical boolean, detected_at timestamp")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for first in range(0, 240, 60):
        spark.createDataFrame(rows[first:first + 60], schema).coalesce(1).write.mode("append").parquet(src)
    late = (999, "s", "u", "late", "npa", 5, True, T0 - timedelta(days=30))
    spark.createDataFrame([late, (998, "s", "u", "x", "npa", 5, True, None)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    write = jobs.digest_writer(lambda texts, epoch: texts.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"), 7)
    q = (jobs.weekly_changes(stream, 7, "1 day").writeStream.foreachBatch(write)
         .option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {g.week_end: g for g in spark.read.parquet(out).collect()}
    week = timedelta(days=7)
    assert set(got) == {T0 + week, T0 + 2 * week}  # the third week is not over
    for end, g in got.items():
        own = [x for x in rows if end - week <= x[-1] < end]
        best = sorted(own, key=lambda x: (x[5] is None, -(x[5] or 0), -x[-1].timestamp(), x[0]))[:7]
        text = digest.digest_text(spark.createDataFrame(best, schema), F.lit(end.strftime("%d.%m.%Y"))).first()
        assert (g.content_md, g.listed, g.max_score) == (text.content_md, 7, text.max_score)
        assert g.all_changes == len(own) and g.legal_changes == sum(x[4] == "npa" or bool(x[6]) for x in own)


class MemoryState:
    """State of one key in memory; counts how often it is asked."""

    def __init__(self):
        self.value, self.items, self.map, self.calls, self.timers = None, [], {}, 0, []

    def getValueState(self, *_):
        return self

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return max(self.timers) + 10 ** 9

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.items or self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.items = []

    def appendList(self, entries):
        self.calls += 1
        self.items = self.items + entries

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]


class Waiting(MemoryState):
    def getValueState(self, name, *_):
        return self.__dict__.setdefault(name, MemoryState())

    getListState = getMapState = getValueState


def test_waiting_snapshots_are_stored_and_released_in_chunks():
    import pandas as pd

    from auditspan.streaming.processors import SnapshotRouter
    store, router = Waiting(), SnapshotRouter()
    router.init(store)
    rows = [(i * 1_000_000, i, f"h{i % 2}", f"t{i % 2}", "ok", 1) for i in range(3000)]  # 50 minutes
    random.Random(2).shuffle(rows)
    frames = [pd.DataFrame(rows[a:a + 1000], columns=["at", "id", "content_hash", "raw_text", "fetch_status", "items"])
              for a in (0, 1000, 2000)]
    assert list(router.handleInputRows(("s", "u"), iter(frames), store)) == []
    out = pd.concat(router.handleExpiredTimer(("s", "u"), store, None))
    assert list(out["id"]) == list(range(3000)) and list(out["route"]) == ["baseline"] + ["changed"] * 2999
    assert not store.waiting.map and not store.due.items
    assert store.waiting.calls + store.due.calls < 30  # not several for every row


def test_arriving_pages_are_dealt_out(spark):
    pages = spark.createDataFrame([], schemas.CRAWL)
    plan = jobs.arriving_pages(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [url" in plan


def test_a_week_is_counted_and_cut_by_frames():
    import pandas as pd

    from auditspan.streaming.processors import BestOfWeek

    class Week(Waiting):
        def put(self, items):
            self.items = items

        def getValueState(self, name, *_):
            return self.__dict__.setdefault("own_" + name, Week())

        getListState = getValueState

        def getCurrentWatermarkInMs(self):
            return 0

    store, week = Week(), BestOfWeek(3)
    week.init(store)
    rows = [(i or week.NONE, "s", "u", None, "ui", i % 4 or None, None if i % 2 else True, i % 5, i % 2 == 0) for i in range(400)]
    frames = [pd.DataFrame(rows[a:a + 100], columns=[*week.FIELDS, "legal"]) for a in range(0, 400, 100)]
    assert list(week.handleInputRows((10 ** 9, 1), iter(frames), store)) == []
    out = pd.concat(week.handleExpiredTimer((10 ** 9, 1), store, None))
    assert list(out["id"]) == [19, 39, 59] and list(out["changes"]) == [400, 0, 0] and list(out["legal_changes"]) == [200, 0, 0]
    assert list(out["threat_score"]) == [3, 3, 3]


def test_known_updates_are_asked_for_once_a_part():
    import pandas as pd

    from auditspan.streaming.processors import FirstSeen

    class Keys(MemoryState):
        def appendValue(self, value):
            self.appendList([value])

        def put(self, items):
            self.calls, self.items = self.calls + 1, items

        def get(self):
            self.calls += 1
            return iter(self.items)

    store, first = Keys(), FirstSeen()
    store.getListState = lambda *_: store
    first.init(store)
    for part in (["k0", "k1"], ["k2"]):
        first.handleInitialState((1,), pd.DataFrame({"content_key": part, "part": 1}), None)
    for batch in range(50):
        rows = [(f"k{i}", "s", f"t{at}", at) for i in range(batch * 20, batch * 20 + 30) for at in (7, first.LATEST, 5)]
        frames = [pd.DataFrame(rows[a:a + 40], columns=first.FIELDS) for a in range(0, 90, 40)]
        out = pd.concat(first.handleInputRows((1,), iter(frames), None))
        assert list(out["content_key"]) == [f"k{i}" for i in range(batch * 20 + (10 if batch else 3), batch * 20 + 30)]
        assert set(out["title"]) == {"t5"}
    assert store.calls <= 2 + 2 * 50 and len(store.items) <= first.TEXTS
