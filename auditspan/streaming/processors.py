"""Stateful processors: what a stream remembers between micro-batches.

Rows are consumed one by one and state is read and written in small chunks, so a task holds only a bounded
part of a key's rows, or those of one short span of time, however many rows the key has.
State lives in RocksDB (:func:`use_rocksdb`) and is restored from the checkpoint after a loss.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: entries that are handed to the state store at once
_CHUNK = 500


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that value, list and map state need; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SnapshotRouter(StatefulProcessor):
    """Routes the snapshots of a page in the order of their time.

    An arriving snapshot waits until the watermark reaches its time; an event-time timer then releases what is
    due in order of (time, id).  A snapshot older than one already released, and one without a time, is
    reported as late at once and changes nothing.

    Waiting snapshots are stored by spans of :data:`SPAN` in chunks, lists of one value for each field, so
    that the state store is asked once a chunk and not for every row.  A task holds the rows it gathers
    for the next chunks (:data:`GATHERED`, :data:`CHARACTERS`) or, on release, those of one span.

    Rows come and go in frames, which cost less than single rows; times and ids are numbers in them, with
    :data:`NONE` for a missing one.
    """

    NONE = -2 ** 63
    FIELDS = ["at", "id", "content_hash", "raw_text", "fetch_status", "items"]
    ROUTED = ["id", "at", "fetch_status", "route", "previous_hash", "previous_text", "raw_text", "parse_warning"]
    ROUTED_TYPES = ("source_id string, url string, id long, at long, fetch_status string, route string, "
                    "previous_hash string, previous_text string, raw_text string, parse_warning boolean")

    #: microseconds of the time spans that are put in order one after another
    SPAN = 15 * 60 * 1_000_000
    #: rows and characters that are gathered before they are stored
    GATHERED = 20_000
    CHARACTERS = 16_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState(
            "last", "content_hash string, raw_text string, at long, id long, recent array<int>, arrived long")
        self.due = handle.getListState("due", "span long, number long, low long")
        self.waiting = handle.getMapState(
            "waiting", "span long, number long",
            "at array<long>, id array<long>, number array<long>, content_hash array<string>, raw_text array<string>, "
            "fetch_status array<string>, items array<int>")

    def _state(self) -> tuple:
        return tuple(self.last.get()) if self.last.exists() else (None, None, None, None, [], 0)

    def _append(self, entries: list[tuple]) -> None:
        for first in range(0, len(entries), _CHUNK):
            self.due.appendList(entries[first:first + _CHUNK])

    def _store(self, rows: list[tuple]) -> list[tuple]:
        """Store rows of (at, id, number, ...) span by span; the entries of their chunks."""
        spans: dict[int, list[tuple]] = {}
        for row in rows:
            spans.setdefault(row[0] // self.SPAN, []).append(row)
        entries = []
        for span, own in spans.items():
            # the number of its first row names a chunk
            self.waiting.updateValue((span, own[0][2]), tuple(list(field) for field in zip(*own)))
            entries.append((span, own[0][2], min(row[0] for row in own)))
        return entries

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *known, number = self._state()
        gathered, characters, first = [], 0, None
        for frame in rows:
            late = []
            for at, id_, content_hash, text, status, items in frame[self.FIELDS].itertuples(index=False, name=None):
                if at == self.NONE or (known[2] is not None and (at, id_) < (known[2], known[3])):
                    late.append((id_, at, status, "late", None, None, text, False))
                    continue
                number += 1
                gathered.append((at, id_, number, content_hash, text, status, items))
                characters += len(text or "")
                first = at if first is None else min(first, at)
                if len(gathered) >= self.GATHERED or characters >= self.CHARACTERS:
                    self._append(self._store(gathered))
                    gathered, characters = [], 0
            if late:
                yield self._frame(key, late)
        self._append(self._store(gathered))
        if first is not None:
            self.last.update((*known, number))
            self.handle.registerTimer(first // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        ready, later = {}, []
        for entry in self.due.get():
            span, chunk, low = entry
            if low // 1000 <= reached:
                ready.setdefault(span, []).append(chunk)
            else:
                later.append((span, chunk, low))
        if not ready:
            return
        last_hash, last_text, at, id_, recent, number = self._state()
        recent = list(recent)
        routed, characters = [], 0
        for span in sorted(ready):
            rows = []
            for chunk in ready[span]:
                rows += zip(*self.waiting.getValue((span, chunk)))
                self.waiting.removeKey((span, chunk))
            rows.sort(key=lambda row: row[:3])
            for place, (now, own, _, content_hash, text, status, items) in enumerate(rows):
                if now // 1000 > reached:
                    later += self._store(rows[place:])
                    break
                good, warning, route = status == "ok", False, "failed"
                items = int(items or 0) if good else 0
                warning = items == 0 and len(recent) == 3 and all(n > 0 for n in recent)
                if good:
                    route = "baseline" if at is None else "unchanged" if last_hash == content_hash else "changed"
                    recent = [items, *recent][:3]
                routed.append((own, now, status, route, last_hash, last_text, text, warning))
                characters += len(text or "")
                if len(routed) >= self.GATHERED or characters >= self.CHARACTERS:
                    yield self._frame(key, routed)
                    routed, characters = [], 0
                last_hash, last_text, at, id_ = content_hash, text, now, own
        if routed:
            yield self._frame(key, routed)
        self.due.clear()
        self._append(later)
        if later:
            self.handle.registerTimer(min(low for _, _, low in later) // 1000)
        self.last.update((last_hash, last_text, at, id_, recent, number))

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=self.ROUTED)
        frame.insert(0, "source_id", key[0])
        frame.insert(1, "url", key[1])
        return frame


class FirstSeen(StatefulProcessor):
    """Lets the earliest row of a ``content_key`` pass once; keys of the initial state never come out.

    Keys are kept by parts: a part's keys lie in a few joined texts, so the state store is asked once a part and
    not for every key.  A task holds the keys of one part and one row for each of its keys that arrive.
    """

    #: stands for a missing time, which comes last
    LATEST = 2 ** 63 - 1
    FIELDS = ["content_key", "source", "title", "found_at"]
    #: texts that a part's keys lie in before they are joined to one
    TEXTS = 32

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "content_keys string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.appendValue((" ".join(initialState["content_key"]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            first = pd.concat([first, frame[self.FIELDS]]).sort_values("found_at", kind="stable").drop_duplicates("content_key")
        texts = [text for text, in self.seen.get()]
        new = first[~first["content_key"].isin(set(" ".join(texts).split()))]
        if len(new):
            added = " ".join(new["content_key"])
            if len(texts) < self.TEXTS:
                self.seen.appendValue((added,))
            else:
                self.seen.put([(" ".join([*texts, added]),)])
            yield new


class BestOfWeek(StatefulProcessor):
    """Keeps the totals and the best ``limit`` changes of one part of a week until the week is over."""

    NONE = SnapshotRouter.NONE
    FIELDS = ["id", "source_id", "url", "diff_summary", "change_type", "threat_score", "npa_critical", "at"]
    CHANGE = ("id long, source_id string, url string, diff_summary string, change_type string, threat_score int, "
              "npa_critical boolean, at long")

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "changes long, legal_changes long")
        self.best = handle.getListState("best", self.CHANGE)

    def _cut(self, changes: pd.DataFrame) -> pd.DataFrame:
        """The best changes: highest score first, then newest, then smallest id; what is missing comes last."""
        missing = changes["id"] == self.NONE
        return changes.assign(_missing=missing).sort_values(
            ["threat_score", "at", "_missing", "id"], ascending=[False, False, True, True], na_position="last",
        ).head(self.limit).drop(columns="_missing")

    @staticmethod
    def _plain(changes: pd.DataFrame) -> list[tuple]:
        """Rows for the state, with None for what is missing."""
        return [(id_, source, url, summary, kind, None if pd.isna(score) else int(score), critical, at)
                for id_, source, url, summary, kind, score, critical, at in changes.itertuples(index=False, name=None)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] // 1000 <= timerValues.getCurrentWatermarkInMs():
            return  # the week's digest has been handed on
        count, legal = tuple(self.totals.get()) if self.totals.exists() else (0, 0)
        best = self._frame([tuple(c) for c in self.best.get()] if count else [])
        for frame in rows:
            count += len(frame)
            legal += int(frame["legal"].sum())
            best = self._cut(pd.concat([best, self._frame(self._plain(self._cut(frame[self.FIELDS])))]))
        self.totals.update((count, legal))
        self.best.put(self._plain(best))
        self.handle.registerTimer(key[0] // 1000)
        yield from ()

    def _frame(self, changes: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(changes, columns=self.FIELDS).astype(
            {"id": "int64", "at": "int64", "threat_score": "float64", "npa_critical": "object"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.totals.exists():
            return
        count, legal = self.totals.get()
        out = pd.DataFrame([tuple(c) for c in self.best.get()], columns=self.FIELDS)
        out["threat_score"] = out["threat_score"].astype("Int32")
        out.insert(0, "week_end", key[0])
        out.insert(1, "part", key[1])
        # the totals of a part stand in its first row
        out["changes"], out["legal_changes"] = [[n, *[0] * len(out)][:len(out)] for n in (count, legal)]
        yield out
        self.totals.clear()
        self.best.clear()
