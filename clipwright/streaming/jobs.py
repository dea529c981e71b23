"""Streams of frame observations and progress lines; each job keeps to the meaning of its batch operator."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, nullcontext
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.events import exploded_events
from ..operators.cache import valid_entries
from ..operators.lifecycle import ASSISTED, _Seen
from ..sources.tables import shared_folder

#: Phases whose numbers a run's state holds; others are passed over.
REDUCED = ("scan", "dedupe", "trim", "merge")

#: So many low bits of a run's and of a source's number are left out of its state's key.
RUN_BITS, SOURCE_BITS = 5, 4


def text_event_stream(frames: DataFrame, target: str = "both") -> DataFrame:
    """Frames to events, row by row."""
    return exploded_events(frames, target)


def _clock(time: str) -> Column:
    """Event time for a watermark: Spark's begins at 1970 and drops what is not after it, such as media time 0, from the first batch on."""
    first = F.timestamp_millis(F.lit(1))
    return F.when(F.col(time) < first, first).otherwise(F.col(time))


def without_repeats(events: DataFrame, time: str, delay: str = "5 seconds") -> DataFrame:
    """The first sighting of each key within the delay."""
    timed = events.withColumn("_clock", _clock(time)).withWatermark("_clock", delay)
    return timed.dropDuplicatesWithinWatermark(["source_idx", "target", "event_key"]).drop("_clock")


def clip_windows(windows: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Merged windows of timed events (source_idx, win_start, win_end as timestamps).

    A session ends a microsecond after its window, so that windows which touch
    merge.  The start is the least start, which is the first event's where the
    seconds before are the same for all.  In append mode a session comes out when
    the watermark passes it; drain a bounded input in complete mode, or the
    sessions of its last hour and rows behind the watermark are lost.
    """
    gap = F.concat((F.unix_micros("win_end") - F.unix_micros("win_start") + 1).cast("string"), F.lit(" microseconds"))
    session = F.session_window("win_start", gap)
    grouped = windows.withWatermark("win_start", delay).groupBy("source_idx", session)
    return grouped.agg(F.count("*").alias("event_count"), F.min("win_start").alias("start_at"), F.max("win_end").alias("end_at")).drop("session_window")


def known_lines(lines: DataFrame) -> DataFrame:
    """(run_id, phase, seq, current, total) of lines that may change a state: a reported phase, a place, and no number below zero."""
    fit = F.col("phase").isin(*REDUCED) & F.col("seq").isNotNull() & F.coalesce(F.col("current") >= 0, F.lit(True)) & F.coalesce(F.col("total") >= 0, F.lit(True))
    return lines.filter(fit).select("run_id", "phase", F.col("seq").cast("bigint").alias("seq"), F.col("current").cast("bigint").alias("current"), F.col("total").cast("bigint").alias("total"))


def reduced(lines: Iterable[tuple[int, int | None, int | None]], state: tuple[int, int, int] | None = None) -> tuple[int, int, int] | None:
    """The last valid (seq, current, total) after lines in order.

    A missing number is the last valid one, 0 at first; a line is valid if its
    numbers, inherited ones included, keep current within total.
    """
    seq, current, total = state or (None, 0, 0)
    for n, c, t in lines:
        if seq is not None and n <= seq:
            continue
        c, t = current if c is None else c, total if t is None else t
        if c <= t:
            seq, current, total = n, c, t
    return None if seq is None else (seq, current, total)


def _plain(columns: Iterable[pd.Series | pa.Array]) -> Iterator[tuple]:
    """Rows with missing numbers as None."""
    return zip(*([None if v is None or v != v else int(v) for v in c.to_pylist()] if isinstance(c, pa.Array) else [None if pd.isna(v) else int(v) for v in c] for c in columns), strict=True)


_STATE = "run_id bigint, phase string, seq bigint, current bigint, total bigint"


def _is_done(states: DataFrame) -> DataFrame:
    """``done``: a scan that has all of its total; other phases end by an event of their own."""
    return states.withColumn("done", (F.col("phase") == "scan") & (F.col("current") == F.col("total")))


class _Progress(StatefulProcessor):
    """One phase of a run: its last valid line; ``_Runs`` is the form for many short runs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, current bigint, total bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        lines = sorted(chain.from_iterable(_plain(f[c] for c in ("seq", "current", "total")) for f in rows), key=lambda r: r[0])
        now = reduced(lines, before)
        if now is not None and now != before:
            self.last.update(now)
            yield pd.DataFrame([(*key, *now)], columns=["run_id", "phase", "seq", "current", "total"])

    def close(self) -> None:
        pass


class _Runs(StatefulProcessor):
    """The phases of up to ``2**RUN_BITS`` neighbouring runs: their last valid lines as one value, since a call and its way to the store cost more than the lines of a run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"states array<struct<{_STATE.replace(' ', ':').replace(',:', ',')}>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = {(r[0], r[1]): tuple(r[2:]) for r in self.last.get()[0]} if self.last.exists() else {}
        given: dict[tuple, list] = {}
        for f in rows:
            for (run,), phase, line in zip(_plain([f["run_id"]]), f["phase"], _plain(f[c] for c in ("seq", "current", "total")), strict=True):
                given.setdefault((run, phase), []).append(line)
        new = {at: reduced(sorted(lines, key=lambda r: r[0]), held.get(at)) for at, lines in given.items()}
        new = {at: now for at, now in new.items() if now is not None and now != held.get(at)}
        if new:
            self.last.update(([(*at, *now) for at, now in (held | new).items()],))
            yield pd.DataFrame([(*at, *now) for at, now in new.items()], columns=["run_id", "phase", "seq", "current", "total"])

    def close(self) -> None:
        pass


def progress_stream(lines: DataFrame) -> DataFrame:
    """(run_id, phase, seq, current, total, done): the last valid state of each run's phase whenever it changes, in update mode.

    Lines are taken in the order of ``seq`` within a micro-batch, whatever
    chunks they come in; one that comes after a later line is passed over.
    Neighbouring runs share a state.  Needs the RocksDB state store, see
    ``typed_state``.
    """
    near = known_lines(lines).withColumn("run_id", F.col("run_id").cast("bigint")).withColumn("runs", F.shiftright("run_id", RUN_BITS))
    return _is_done(near.groupBy("runs").transformWithStateInPandas(_Runs(), _STATE, "update", "none"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by run, phase and seq; what is held is the state of the phase at hand."""
    at, state, out = None, None, []
    for b in batches:
        runs, phases = b.column("run_id").to_pylist(), b.column("phase").to_pylist()
        rows = list(_plain(b.column(c) for c in ("seq", "current", "total")))
        first = 0
        while first < len(rows):
            key, end = (runs[first], phases[first]), first
            while end < len(rows) and (runs[end], phases[end]) == key:
                end += 1
            if key != at:
                out += [(*at, *state)] if state else []
                at, state = key, None
            state = reduced(rows[first:end], state)
            first = end
        if len(out) >= 10_000:
            yield _states(out)
            out = []
    yield _states(out + ([(*at, *state)] if state else []))


def _states(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ("run_id", "phase", "seq", "current", "total"), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def progress_table(lines: DataFrame) -> DataFrame:
    """The same from a table, in one pass over its lines in order.

    After a line with both numbers, current within total, nothing before it
    matters; only the lines from the last such one on are put in order.
    """
    fit = known_lines(lines)
    whole = fit.filter("current <= total").groupBy("run_id", "phase").agg(F.max("seq").alias("from"))
    open_ = fit.join(whole, ["run_id", "phase"], "left").filter(F.col("from").isNull() | (F.col("seq") >= F.col("from"))).drop("from")
    return _is_done(open_.repartition("run_id", "phase").sortWithinPartitions("run_id", "phase", "seq").mapInArrow(_folded, _STATE))


#: What first sightings are held as: a row for each group of sources and micro-batch, with a list for each column.
_SHOWN = ("source_idx", "target", "action", "key", "name", "actor", "ms")
_SIGHTINGS = ", ".join(f"{c} array<{'bigint' if c in ('source_idx', 'ms') else 'string'}>" for c in _SHOWN)


class _Lifecycle(StatefulProcessor):
    """Up to ``2**SOURCE_BITS`` neighbouring sources: what each of their targets has shown, a sighting for each first one; repeats add nothing.

    A call, a timer and each way to the store cost more than the events of a
    source, so neighbours share them.  Each source and target still has an end
    of its own, after which what it has shown is forgotten.
    """

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getListState("shown", _SIGHTINGS)
        self.ends = handle.getValueState("ends", "ends array<struct<source_idx:bigint,target:string,at:bigint>>")

    def _held(self) -> list[tuple]:
        return [row for part in self.shown.get() for row in zip(*part, strict=True)]

    def _ends(self) -> dict[tuple, int]:
        return {(r[0], r[1]): r[2] for r in self.ends.get()[0]} if self.ends.exists() else {}

    def _hold(self, ends: dict[tuple, int]) -> None:
        """The ends written, and one timer for the first of them."""
        first = min(ends.values(), default=None)
        timers = list(self.handle.listTimers())
        for old in timers:
            if old != first:
                self.handle.deleteTimer(old)
        if first is None:
            self.ends.clear()
            return
        self.ends.update(([(*at, end) for at, end in ends.items()],))
        if first not in timers:
            self.handle.registerTimer(first)

    def _forget(self, held: list[tuple], ends: dict[tuple, int], over: set[tuple]) -> None:
        """What the targets that are over have shown goes."""
        left = [row for row in held if row[:2] not in over]
        if left:
            self.shown.put([tuple(map(list, zip(*left, strict=True)))])
        else:
            self.shown.clear()
        self._hold({at: end for at, end in ends.items() if at not in over})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, ends, now = self._held(), self._ends(), timerValues.getCurrentWatermarkInMs()
        seen: dict[tuple, _Seen] = {}
        for row in held:
            (seen.get(row[:2]) or seen.setdefault(row[:2], _Seen(row[1]))).add(*row[2:])
        given = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "ord"], kind="stable")
        out, new = [], []
        for source, target, ms, action, key_, name, actor, assisted in zip(*(given[c].tolist() for c in ("source_idx", "target", "ms", "action", "key", "name", "actor", "assisted")), strict=True):
            own = seen.get((source, target)) or seen.setdefault((source, target), _Seen(target))
            if own.repeats(action, key_, name, ms):
                out.append((source, target, ms, key_, "repeat"))
                continue
            out.append((source, target, ms, key_, own.follows(action, actor, ms) or (ASSISTED if assisted else "kept")))
            new.append((source, target, action, key_, name, actor, ms))
            own.add(action, key_, name, actor, ms)
        last = {at: max(int(t.timestamp() * 1000), now) + self.expire_ms for at, t in given.groupby(["source_idx", "target"])["at"].max().items()}
        over = {at for at, end in ends.items() if end < now and at not in last}
        if over:
            self._forget(held + new, ends | last, over)
        else:
            if new:
                self.shown.appendList([tuple(map(list, zip(*new, strict=True)))])
            self._hold(ends | last)
        yield pd.DataFrame(out, columns=["source_idx", "target", "ms", "key", "decision"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends, now = self._ends(), timerValues.getCurrentWatermarkInMs()
        over = {at for at, end in ends.items() if end <= expiredTimerInfo.getExpiryTimeInMs() or end < now}
        if over:
            self._forget(self._held(), ends, over)
        yield pd.DataFrame({"source_idx": pd.Series([], dtype="int64"), "target": pd.Series([], dtype=object), "ms": pd.Series([], dtype="int64"), "key": pd.Series([], dtype=object), "decision": pd.Series([], dtype=object)})

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, time: str = "at", delay: str = "10 seconds", expire_ms: int = 3_600_000) -> DataFrame:
    """(source_idx, target, ms, key, decision): each event's decision, by the rules and in the order of ``lifecycle.decided``.

    State is a list of first sightings for neighbouring sources; a micro-batch
    appends its new ones and an event-time timer takes those of a source and
    target out ``expire_ms`` after its last event.  Events are taken in time
    order within a micro-batch; rows later than the watermark are dropped.  So
    with rows that come in order of micro-batches and no silence longer than
    ``expire_ms`` the decisions are those of the batch form.  ``assisted``
    counts as false where the events have no such column.  Needs the RocksDB
    state store, see ``typed_state``.
    """
    assisted = F.coalesce("assisted", F.lit(False)) if "assisted" in events.columns else F.lit(False)
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("action", "key", "name", "actor")]
    rows = events.select("source_idx", "target", "ms", "ord", *text, assisted.alias("assisted"), _clock(time).alias("at")).withWatermark("at", delay)
    near = rows.withColumn("sources", F.shiftright(F.col("source_idx").cast("bigint"), SOURCE_BITS))
    return near.groupBy("sources").transformWithStateInPandas(_Lifecycle(expire_ms), "source_idx bigint, target string, ms bigint, key string, decision string", "append", "eventTime")


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store, which lists, values and timers need, for the queries started within."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def new_only(cache_path: str, compute: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: sources without a valid cache entry are computed and appended to the cache."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = valid_entries(spark.read.schema("cache_key string, schema int, checksum string, payload string").parquet(cache_path))
        compute(batch.dropDuplicates(["cache_key"]).join(known, "cache_key", "left_anti")).write.mode("append").parquet(cache_path)

    return run


class LateRows(StreamingQueryListener):
    """Adds up the rows that the watermark dropped over every progress report of a query, however many there are."""

    def __init__(self):
        self.by_query: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.by_query.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.by_query[str(p.id)] = self.by_query.get(str(p.id), 0) + sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))


def late_rows(spark: SparkSession, start: Callable[[], StreamingQuery], patience: float = 60.0) -> int:
    """Rows that the watermark dropped in the query that ``start`` starts and that ends by itself.

    Reports reach a listener in their order and the end comes last, so the sum
    is whole once the end is there; raises TimeoutError if it does not come.
    """
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        query = start()
        query.awaitTermination()
        left = time.monotonic() + patience
        while str(query.id) not in listener.ended:
            if time.monotonic() > left:
                raise TimeoutError("the query's end was not reported")
            time.sleep(0.05)
        return listener.by_query[str(query.id)]
    finally:
        spark.streams.removeListener(listener)


def work_folder(spark: SparkSession) -> str:
    """A fresh folder for a stream's checkpoint and output, in the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append", typed: bool = False) -> DataFrame:
    """Run a stream over all input there is and read back what it gave, with the number of each ``batch``.

    In complete mode that is the whole table of the last batch, what is still open included.
    ``typed`` streams keep their state in RocksDB.
    """
    spark = stream.sparkSession
    folder = work_folder(spark)

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0)).write.parquet(f"{folder}/out")
    with typed_state(spark) if typed else nullcontext():
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
