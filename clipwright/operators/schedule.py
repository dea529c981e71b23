"""Which moments of a recording are read, and what the reads cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ms_key
from .telemetry import ranks


@dataclass(frozen=True)
class Scan:
    """Settings of a schedule, in seconds; steps are whole milliseconds."""

    start: float = 0.0
    end: float | None = None
    coarse_step: float = 4.0
    candidate_step: float = 4.0
    lookback: float = 8.0
    lookahead: float = 0.5
    windows: list = field(default_factory=lambda: [(31.0, 43.0), (45.0, 53.0)])
    full: bool = True
    adaptive_step: float = 0.5
    adaptive_window: float = 2.0

    def __post_init__(self):
        for name in ("coarse_step", "candidate_step", "adaptive_step"):
            step = getattr(self, name)
            if not 0 < step < float("inf") or abs(step * 1000 - round(step * 1000)) > 1e-6:
                raise ValueError(f"{name} must be a positive whole number of milliseconds")
        _refuse(("start", "lookback", "lookahead", "adaptive_window"), self, lambda x: 0 <= x < float("inf"), "a finite number and not negative")
        if self.end is not None and not self.start < self.end < float("inf"):
            raise ValueError("end must be finite and after start")
        if not all(len(w) == 2 and 0 <= w[0] < w[1] < float("inf") for w in self.windows):
            raise ValueError("a priority window must be finite, not negative, and end after it begins")


def _refuse(names: tuple[str, ...], given: object, fits: Callable[[object], bool], what: str) -> None:
    for name in names:
        if not fits(getattr(given, name)):
            raise ValueError(f"{name} must be {what}")


def is_region(box: Sequence[float]) -> bool:
    """x1, y1, x2, y2 as ratios of a frame, the second corner below and right of the first."""
    return len(box) == 4 and 0 <= box[0] < box[2] <= 1 and 0 <= box[1] < box[3] <= 1


def region(text: str) -> tuple[float, ...]:
    """A region as written in settings: four numbers with commas between."""
    try:
        box = tuple(float(part) for part in text.split(","))
    except ValueError:
        box = ()
    if not is_region(box):
        raise ValueError(f"a region is x1,y1,x2,y2 in ascending ratios from 0 to 1: {text}")
    return box


def window(text: str) -> tuple[float, float]:
    """A window as written in settings: start:end in seconds."""
    try:
        lo, hi = (float(part) for part in text.split(":", 1))
    except ValueError:
        lo, hi = 0.0, 0.0
    if not 0 <= lo < hi < float("inf"):
        raise ValueError(f"a window is start:end in seconds, 0 <= start < end: {text}")
    return lo, hi


def valid_region(box: Column) -> Column:
    """``is_region`` of a row's array of four numbers; false for a null and for one with nulls."""
    a, b, c, d = (F.get(box, F.lit(i)) for i in range(4))
    ordered = (a >= 0) & (a < c) & (c <= 1) & (b >= 0) & (b < d) & (d <= 1)
    return F.coalesce((F.size(box) == 4) & ordered, F.lit(False))


@dataclass(frozen=True)
class Recognition:
    """Settings of the reading of frames, checked when made; seconds, and regions as ratios of a frame."""

    roi: tuple = (0.0, 0.0, 1.0, 1.0)
    assist_roi: tuple = (0.0, 0.0, 1.0, 1.0)
    brightness_gate_roi: tuple = (0.0, 0.0, 1.0, 1.0)
    brightness_gate_mode: str = "full"
    sampling_mode: str = "fixed"
    refine_step: float = 0.5
    refine_search_step: float = 1.0
    assist_step: float = 0.5
    refine_before: float = 6.0
    refine_after: float = 0.0
    assist_after: float = 1.2
    min_interval: float = 0.0
    refine_max_seconds: float | None = None
    assist_max_seconds: float | None = None
    frame_cache: int = 1

    def __post_init__(self):
        _refuse(("roi", "assist_roi", "brightness_gate_roi"), self, is_region, "ascending ratios between 0 and 1")
        _refuse(("refine_step", "refine_search_step", "assist_step"), self, lambda x: x > 0, "positive")
        _refuse(("refine_before", "refine_after", "assist_after", "min_interval"), self, lambda x: 0 <= x < float("inf"), "a finite number and not negative")
        _refuse(("refine_max_seconds", "assist_max_seconds"), self, lambda x: x is None or 0 <= x < float("inf"), "None or a finite number and not negative")
        _refuse(("frame_cache",), self, lambda x: x >= 1, "positive")
        _refuse(("brightness_gate_mode",), self, ("full", "light", "none").__contains__, "full, light or none")
        _refuse(("sampling_mode",), self, ("fixed", "adaptive").__contains__, "fixed or adaptive")


def steps(lo: Column, hi: Column, step: float) -> Column:
    """Milliseconds from ``lo`` to ``hi`` seconds, both included; empty if they are out of order or not finite."""
    a, b = ms_key(lo), ms_key(hi)
    ok = lo.isNotNull() & hi.isNotNull() & ~F.isnan(lo) & ~F.isnan(hi) & (F.abs(lo) < float("inf")) & (F.abs(hi) < float("inf")) & (hi >= lo)
    return F.when(ok & (b >= a), F.sequence(a, F.greatest(a, b), F.lit(round(step * 1000)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def times(duration: Column, hints: Column, scan: Scan, adaptive: bool = False, full: Column | None = None) -> Column:
    """Sorted distinct milliseconds: coarse steps, priority windows and windows around hints.

    The adaptive schedule adds the ends of each window and the hint itself.
    """
    end = F.least(duration, F.lit(scan.end)) if scan.end is not None else duration
    low = F.lit(max(scan.start, 0.0))
    none = F.array().cast("array<bigint>")
    coarse = steps(F.lit(scan.start), end, scan.coarse_step)
    parts = [F.when(full if full is not None else F.lit(scan.full), coarse).otherwise(none)]

    def window(lo: Column, hi: Column, extra: Column | None = None) -> Column:
        found = steps(lo, hi, scan.candidate_step)
        if adaptive:
            ends = F.array(ms_key(lo), ms_key(hi))
            if extra is not None:
                ends = F.concat(ends, F.when(extra.between(lo, hi), F.array(ms_key(extra))).otherwise(none))
            found = F.when(F.size(found) > 0, F.concat(found, ends)).otherwise(found)
        return found

    for a, b in scan.windows:
        parts.append(window(F.greatest(low, F.lit(float(a))), F.least(end, F.lit(float(b)))))
    around = F.transform(F.coalesce(hints, F.array().cast("array<double>")), lambda h: window(F.greatest(low, h - scan.lookback), F.least(end, h + scan.lookahead), h))
    return F.array_sort(F.array_distinct(F.concat(*parts, F.flatten(around))))


def scheduled(sources: DataFrame, scan: Scan, adaptive: bool = False) -> DataFrame:
    """(source_idx, ms): one row for each moment of each source (duration_sec, hints, and perhaps force_full_scan).

    A source with hints is scanned only around them and in the windows, unless the full scan is forced.
    """
    full = F.lit(scan.full)
    if "force_full_scan" in sources.columns:
        full = full & (F.col("force_full_scan") | (F.size("hints") == 0))
    return sources.select("source_idx", F.explode(times(F.col("duration_sec"), F.col("hints"), scan, adaptive, full)).alias("ms"))


def expanded(seeds: DataFrame, scan: Scan) -> DataFrame:
    """(source_idx, ms): seeds, and from each seed with an event (``n_events``) the moments after it; added ones are no seeds."""
    span = F.sequence(F.col("ms"), F.col("ms") + round(scan.adaptive_window * 1000), F.lit(round(scan.adaptive_step * 1000)).cast("bigint"))
    added = seeds.filter("n_events > 0").select("source_idx", F.explode(span).alias("ms"), (F.col("duration_sec") * 1000).alias("_end")).filter("ms <= _end").drop("_end")
    return seeds.select("source_idx", "ms").union(added).distinct()


def observed(schedule: DataFrame, frames: DataFrame) -> DataFrame:
    """The frame of each scheduled read (source_idx, ms, roi); ``method`` says so where there is none."""
    rows = schedule.join(frames, ["source_idx", "ms", "roi"], "left")
    return rows.withColumn("method", F.when(F.coalesce("read_ok", F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit("frame-read-failed")))


def joint_reads(scheduled: DataFrame, refined: DataFrame, assists: DataFrame) -> DataFrame:
    """(source_idx, ms, roi, kind, ord): all reads of each source in the order they are asked for.

    ``scheduled`` has (source_idx, ms); ``refined`` and ``assists`` have
    (source_idx, seed_ms, step, ms): the reads that follow a scheduled one, in
    the order of ``step`` from 0.  Assists look at a region of their own.
    """
    def part(rows: DataFrame, roi: str, kind: int, name: str) -> DataFrame:
        at = F.col("seed_ms").cast("bigint") * (1 << 20) + (kind << 18) + F.col("step").cast("bigint")
        return rows.select("source_idx", F.col("ms").cast("bigint").alias("ms"), F.lit(roi).alias("roi"), F.lit(name).alias("kind"), at.alias("ord"))

    seeds = scheduled.select("source_idx", "ms", F.col("ms").alias("seed_ms"), F.lit(0).alias("step"))
    return part(seeds, "event", 0, "scheduled").unionByName(part(refined, "event", 1, "refine")).unionByName(part(assists, "assist", 2, "assist"))


#: What becomes of a read; the last two are why it is skipped.
READ, CACHED, EXHAUSTED, TOO_SOON = "read", "cached", "ocr-budget-exhausted", "ocr-min-interval"


def ledger(reads: DataFrame, calls: int | None = None, interval_ms: float = 0) -> DataFrame:
    """``outcome`` of each read (source_idx, ms, roi, ord): read, cached, or why it is skipped.

    A source's reads of every kind draw on one budget, in the order of ``ord``,
    which is distinct within a source.  A moment that was read before in the
    same region costs nothing, one that was skipped may be asked for again.
    Nearer than ``interval_ms`` to the last read made, before or after it, a
    read is skipped, too.  Without an interval the last affordable read of a
    source is an exact rank of its first asks, so that no task sees all of
    them; with one each read depends on the last made, and a source's reads are
    folded in order by one task that keeps the moments it has read.
    """
    if calls is not None and calls < 0:
        raise ValueError("calls must not be negative")
    if interval_ms > 0:
        rows = reads.repartition("source_idx").sortWithinPartitions("source_idx", "ord")
        return rows.mapInPandas(_outcomes(calls, interval_ms), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in reads.schema)}, outcome string")
    moment = ["source_idx", "ms", "roi"]
    first = reads.groupBy(F.struct(*moment).alias("_at")).agg(F.min("ord").alias("_first"))
    rows = reads.withColumn("_at", F.struct(*moment)).join(first, "_at")
    affordable = F.lit(True)
    if calls is not None:
        asks = first.select(F.col("_at.source_idx").alias("source_idx"), "_first")
        last = ranks(asks, "source_idx", "_first", lambda n: {"_last": F.least(n, F.lit(max(calls, 1)))})
        rows = rows.join(last, F.col("source_idx").eqNullSafe(F.col("_of")), "left").drop("_of")
        affordable = F.lit(calls > 0) & (F.col("_first") <= F.col("_last"))
    outcome = F.when(~affordable, F.lit(EXHAUSTED)).when(F.col("ord") == F.col("_first"), F.lit(READ)).otherwise(F.lit(CACHED))
    return rows.withColumn("outcome", outcome).select(*reads.columns, "outcome")


def _outcomes(calls: int | None, interval_ms: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, made, known, last = object(), 0, set(), None
        for frame in frames:
            out = []
            for source, ms, roi in zip(frame["source_idx"], frame["ms"], frame["roi"], strict=True):
                source = None if pd.isna(source) else source
                if source != at:
                    at, made, known, last = source, 0, set(), None
                if (roi, ms) in known:
                    out.append(CACHED)
                elif calls is not None and made >= calls:
                    out.append(EXHAUSTED)
                elif last is not None and abs(ms - last) < interval_ms - 1e-3:
                    out.append(TOO_SOON)
                else:
                    made, last = made + 1, ms
                    known.add((roi, ms))
                    out.append(READ)
            yield frame.assign(outcome=out)

    return run


def within_budget(reads: DataFrame, calls: int) -> DataFrame:
    """The reads of each source that ``calls`` allow, by ``ord``; repeats of one (roi, ms) cost nothing."""
    return ledger(reads, calls).filter(F.col("outcome") != EXHAUSTED).drop("outcome")


def repeats(reads: DataFrame) -> DataFrame:
    """``cached``: the moment was read before in the same region (by ``ord``)."""
    order = Window.partitionBy("source_idx", "ms", "roi").orderBy("ord")
    return reads.withColumn("cached", F.row_number().over(order) > 1)


#: Milliseconds of media time that one task looks at together.
SLOT_MS = 3_600_000


def spaced(reads: DataFrame, interval_ms: int, slot_ms: int = SLOT_MS) -> DataFrame:
    """(source_idx, ms) of reads that come at least ``interval_ms`` after the last accepted one.

    Each read links to the first one at least the interval later; what is
    accepted is the chain from a source's first read.  A recording is cut into
    slots.  The chain can enter a slot only at a read less than the interval
    after its begin, or at the first one later; for each of these the slot says
    where the chain leaves it, found by doubling its links.  Going from slot to
    slot over these few rows gives the true entries, and each slot follows its
    own chain.  No task holds a source's reads.
    """
    if interval_ms < 0 or slot_ms < 1:
        raise ValueError("interval_ms must not be negative and slot_ms positive")
    rows = reads.select("source_idx", F.col("ms").cast("bigint").alias("ms")).filter("ms is not null").distinct().withColumn("_slot", F.floor(F.col("ms") / slot_ms)).withColumn("_key", F.struct("source_idx", "_slot"))
    kind = rows.schema["source_idx"].dataType.simpleString()
    dealt = rows.repartition("_key").sortWithinPartitions("_key", "ms").select("source_idx", "_slot", "ms")
    ways = dealt.mapInPandas(_ways(interval_ms, slot_ms), f"source_idx {kind}, _slot bigint, entry bigint, leaves bigint")
    entries = ways.repartition("source_idx").sortWithinPartitions("source_idx", "_slot", "entry").mapInPandas(_entries(interval_ms), f"source_idx {kind}, _slot bigint, entry bigint")
    # dealt again: a broadcast join leaves the rows of a slot where the distinct put them, a skewed one splits them
    entered = rows.join(entries.select(F.struct("source_idx", "_slot").alias("_key"), "entry"), "_key").repartition("_key").sortWithinPartitions("_key", "ms")
    return entered.select("source_idx", "_slot", "ms", "entry").mapInPandas(_chain(interval_ms), f"source_idx {kind}, ms bigint")


def _slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each slot, which come one after the other."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        codes = pd.factorize(frame["source_idx"], use_na_sentinel=False)[0]
        slots = frame["_slot"].to_numpy()
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (slots[1:] != slots[:-1])) + 1).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = frame.iloc[a:b]
            if held and not (held[0]["_slot"].iloc[0] == part["_slot"].iloc[0] and _same(held[0]["source_idx"].iloc[0], part["source_idx"].iloc[0])):
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _same(a, b) -> bool:
    return (pd.isna(a) and pd.isna(b)) or a == b


def _links(ms: np.ndarray, interval_ms: int) -> np.ndarray:
    """The place of the first read at least the interval later, always a later one; the number of reads where there is none."""
    return np.maximum(np.searchsorted(ms, ms + interval_ms), np.arange(1, len(ms) + 1))


def _ways(interval_ms: int, slot_ms: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for slot in _slots(frames):
            ms, n = slot["ms"].to_numpy(), len(slot)
            links = _links(ms, interval_ms)
            last = np.where(links < n, links, np.arange(n))
            while (further := last[last]).tolist() != last.tolist():
                last = further
            may = min(int(np.searchsorted(ms, slot["_slot"].iloc[0] * slot_ms + interval_ms)) + 1, n)
            yield slot.iloc[:may][["source_idx", "_slot"]].assign(entry=ms[:may], leaves=ms[last[:may]])

    return run


def _entries(interval_ms: int):
    """Where the chain enters each slot; rows come sorted by source, slot and entry."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, slot, least = object(), None, None
        for frame in frames:
            keep = []
            for source, own, entry, leaves in zip(frame["source_idx"], frame["_slot"], frame["entry"], frame["leaves"], strict=True):
                source = None if pd.isna(source) else source
                if source != at:
                    at, slot, least = source, None, None
                enters = own != slot and (least is None or entry >= least)
                if enters:
                    slot, least = own, max(leaves + interval_ms, leaves + 1)
                keep.append(enters)
            yield frame[keep][["source_idx", "_slot", "entry"]]

    return run


def _chain(interval_ms: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for slot in _slots(frames):
            ms = slot["ms"].to_numpy()
            links, at, chosen = _links(ms, interval_ms), int(np.searchsorted(ms, slot["entry"].iloc[0])), []
            while at < len(ms):
                chosen.append(at)
                at = int(links[at])
            yield slot.iloc[chosen][["source_idx", "ms"]]

    return run


def gate_summary(frames: DataFrame) -> DataFrame:
    """Skipped frames and their distinct reasons in the order first seen, for each source."""
    first = frames.filter(~F.col("gate_passed")).groupBy("source_idx", "gate_reason").agg(F.min("ms").alias("ms"), F.count("*").alias("n"))
    return first.groupBy("source_idx").agg(F.sum("n").alias("gate_skipped"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ms", "gate_reason"))), lambda x: x["gate_reason"]), ";").alias("gate_reasons"))


def onsets(hits: DataFrame, frames: DataFrame, before_ms: int = 6000) -> DataFrame:
    """``onset_ms``: how far back from a hit its event stays visible without a gap, at most ``before_ms``.

    ``hits`` (source_idx, ms, event_key) and ``frames`` (source_idx, ms, keys),
    the dense table of what each frame shows.  Range join in buckets of the span.
    """
    h = hits.select("source_idx", F.col("ms").alias("hit_ms"), "event_key", F.explode(F.array(F.expr(f"ms div {before_ms}"), F.expr(f"ms div {before_ms} - 1"))).alias("_b"))
    f = frames.select("source_idx", F.col("ms").alias("at"), "keys", F.expr(f"ms div {before_ms}").alias("_b"))
    near = h.join(f, ["source_idx", "_b"]).filter((F.col("at") <= F.col("hit_ms")) & (F.col("at") >= F.col("hit_ms") - before_ms))
    seen = F.array_contains("keys", F.col("event_key"))
    gap = near.groupBy("source_idx", "hit_ms", "event_key").agg(F.max(F.when(~seen, F.col("at"))).alias("gap"), F.array_sort(F.collect_set(F.when(seen, F.col("at")))).alias("on"))
    onset = F.array_min(F.filter("on", lambda t: F.col("gap").isNull() | (t > F.col("gap"))))
    return gap.select("source_idx", F.col("hit_ms").alias("ms"), "event_key", F.coalesce(onset, F.col("hit_ms")).alias("onset_ms"))


def refined_onsets(hits: DataFrame, shown: DataFrame, before_ms: int = 6000, stride_ms: int = 2000, step_ms: int = 500) -> DataFrame:
    """``onset_ms`` by few reads: back from the hit in strides while the event shows, then halving the last stride to ``step_ms``.

    ``hits`` and ``shown`` are (source_idx, ms, event_key), ``shown`` with a row
    for each moment that shows the event; a moment without one does not.  What
    lies between two strides that both show it is not looked at.  The moments
    asked for lie on a grid of steps back from the hit: they become the bits of
    a number for each hit, and strides and halvings are operations on it.
    """
    units = stride_ms // max(step_ms, 1)
    halvings = units.bit_length() - 1
    if step_ms < 1 or units * step_ms != stride_ms or units != 1 << halvings or not 0 < before_ms // step_ms < 63:
        raise ValueError("a stride must be a power of two of steps, and there are at most 62 steps")
    bucket = f"ms div {before_ms}"
    h = hits.select("source_idx", F.col("ms").alias("hit_ms"), "event_key").distinct()
    at = h.withColumn("ms", F.col("hit_ms")).withColumn("_b", F.explode(F.array(F.expr(bucket), F.expr(f"({bucket}) - 1")))).drop("ms")
    seen = shown.select("source_idx", "event_key", F.col("ms").alias("at"), F.expr(bucket).alias("_b"))
    back = F.col("hit_ms") - F.col("at")
    near = at.join(seen, ["source_idx", "event_key", "_b"]).filter(back.between(0, before_ms) & (back % step_ms == 0))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (back / step_ms).cast("int"))
    bits = near.groupBy("source_idx", "hit_ms", "event_key").agg(F.bit_or(bit).alias("_bits"))
    rows = h.join(bits, ["source_idx", "hit_ms", "event_key"], "left").withColumn("_bits", F.coalesce("_bits", F.lit(0).cast("bigint")))
    rows = rows.withColumn("_n", F.floor(F.least(F.lit(before_ms), F.col("hit_ms")) / stride_ms).cast("int"))

    def shows(k: Column) -> Column:
        return F.call_function("shiftright", F.col("_bits"), k.cast("int")).bitwiseAND(F.lit(1)) == 1

    strides = F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.col("_n"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_miss", F.array_min(F.filter(strides, lambda i: ~shows(i * units))))
    rounds = F.sequence(F.lit(1), F.lit(halvings)) if halvings else F.array().cast("array<int>")
    first = F.struct(((F.col("_miss") - 1) * units).alias("on"), (F.col("_miss") * units).alias("off"))

    def halved(state: Column, _: Column) -> Column:
        middle = F.floor((state["on"] + state["off"]) / 2).cast("int")
        return F.when(shows(middle), F.struct(middle.alias("on"), state["off"].alias("off"))).otherwise(F.struct(state["on"].alias("on"), middle.alias("off")))

    steps_back = F.when(F.col("_miss").isNull(), F.col("_n") * units).otherwise(F.aggregate(rounds, first, halved)["on"])
    return rows.select("source_idx", F.col("hit_ms").alias("ms"), "event_key", (F.col("hit_ms") - steps_back * step_ms).cast("bigint").alias("onset_ms"))
