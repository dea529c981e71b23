"""From detections to clip windows: the minimum-event rule, context, and the merge of overlaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import fixed3_of_ms, ms_key
from ..functions.text import is_incendiary_for_planning

EARLY = "skipped-before-min-event-sec"
#: Windows this close still touch.
TOUCH = 1e-6
#: Seconds of media time that one task looks at together; what a recording can show within them bounds its rows.
SLOT_SEC = 3600.0
#: Counters and timings of a detection; a clip has those of its last event.
LAST_OF = ("detector", "gate_reason", "termination_reason", "ocr_seconds", "detect_seconds", "ocr_frame_seconds", "refine_ocr_seconds", "assist_ocr_seconds", "sampled_count", "ocr_coarse_frames",
           "ocr_refine_frames", "ocr_gate_skipped_frames", "ocr_requests", "ocr_successes", "ocr_cache_hits", "ocr_skipped", "refine_budget_used", "assist_budget_used")


@dataclass(frozen=True)
class Planning:
    before: float = 5.0
    after: float = 1.0
    min_event: float | None = 2.0
    incendiary_before: float | None = 10.0
    split_targets: bool = False

    def __post_init__(self):
        for name in ("before", "after", "min_event", "incendiary_before"):
            value = getattr(self, name)
            if value is not None and value != value:
                raise ValueError(f"{name} is not a number")


def early(detections: DataFrame, plan: Planning) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): events before the minimum are skipped, those without a time kept."""
    least = max(plan.min_event or 0.0, 0.0)
    is_early = F.coalesce(F.col("event_sec") < least, F.lit(False))
    return detections.filter(~is_early), detections.filter(is_early).withColumn("method", F.lit(EARLY))


def with_context(kept: DataFrame, plan: Planning) -> DataFrame:
    """Seconds before and after each event: the usual ones, or more before an elimination by fire."""
    usual, after, longer = max(plan.before, 0.0), max(plan.after, 0.0), max(plan.incendiary_before or 0.0, 0.0)
    eliminates = F.exists(F.split(F.coalesce("event_key", F.lit("")), ";"), lambda k: F.get(F.split(k, ":", 3), F.lit(1)) == "eliminate")
    fire = (F.lit(longer > 0) & F.col("event_sec").isNotNull() & F.coalesce(eliminates, F.lit(False))
            & F.coalesce(is_incendiary_for_planning(F.col("event_weapon"), F.col("language")), F.lit(False)))
    return (kept.withColumn("context_rule", F.when(fire, F.lit("molotov-elim-context")).otherwise(F.lit("default")))
            .withColumn("clip_before_sec", F.when(fire, F.lit(max(usual, longer))).otherwise(F.lit(usual)))
            .withColumn("clip_after_sec", F.lit(after)))


def with_windows(kept: DataFrame, plan: Planning) -> DataFrame:
    """``win_start`` and ``win_end`` of each timed event; zero seconds of context mean the plan's."""
    before = F.when(F.col("clip_before_sec") > 0, F.col("clip_before_sec")).otherwise(F.lit(plan.before))
    after = F.when(F.col("clip_after_sec") > 0, F.col("clip_after_sec")).otherwise(F.lit(plan.after))
    start = F.greatest(F.col("event_sec") - before, F.lit(0.0))
    end = F.least(F.col("event_sec") + after, F.col("duration_sec"))
    short = F.least(F.col("win_start") + 0.1, F.col("duration_sec"))
    return (kept.filter(F.col("event_sec").isNotNull()).withColumn("win_start", start).withColumn("win_end", end)
            .withColumn("win_end", F.when(F.col("win_end") <= F.col("win_start"), short).otherwise(F.col("win_end"))))


def numbered_clips(windows: DataFrame, *by: str, slot_sec: float = SLOT_SEC) -> DataFrame:
    """``clip_idx`` from 1 within ``by``: an event that starts after all earlier ends opens a clip.

    Needs one duration for each group, as a source has.  A recording is cut
    into slots of media time, so that no task holds a source.  Of an event that
    opens a clip within its slot only its start and how far the earlier slots
    reach decide whether it does so at all.  A slot is summed up by its reach
    and these starts; prefix aggregates over a group's slots, a row each, say
    for every slot what reaches into it and how many clips open before it.
    Rows are dealt by group and slot once; a struct is their key, so that null
    groups meet, too.
    """
    order = Window.partitionBy("_key").orderBy("event_sec", "det_idx")
    keyed = windows.withColumn("_key", F.struct(*by, F.floor(F.col("event_sec") / slot_sec).alias("_slot")))
    opened = keyed.withColumn("_at", F.max("win_end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    opened = opened.withColumn("_opens", F.col("_at").isNull() | (F.col("win_start") > F.col("_at") + TOUCH)).drop("_at")
    slots = opened.groupBy("_key").agg(F.max("win_end").alias("_end"), F.collect_list(F.when(F.col("_opens"), F.col("win_start"))).alias("_starts"))
    earlier = Window.partitionBy(*[F.col(f"_key.{c}") for c in by]).orderBy("_key._slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_reach", F.max("_end").over(earlier)).withColumn("_n", F.size(F.filter("_starts", lambda x: F.col("_reach").isNull() | (x > F.col("_reach") + TOUCH))))
    slots = slots.withColumn("_ahead", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select("_key", "_reach", "_ahead")
    opens = (F.col("_opens") & (F.col("_reach").isNull() | (F.col("win_start") > F.col("_reach") + TOUCH))).cast("int")
    own = F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return opened.join(slots, "_key").withColumn("clip_idx", own + F.col("_ahead")).drop("_key", "_reach", "_ahead", "_opens")


def _distinct_join(items: str, field: str, sep: str, drop: str = "") -> Column:
    values = F.filter(F.transform(F.col(items), lambda x: x[field]), lambda v: v.isNotNull() & (v != "") & (v != drop))
    return F.array_join(F.array_distinct(values), sep)


def _plain_join(items: str, field: str) -> Column:
    return F.array_join(F.filter(F.transform(F.col(items), lambda x: x[field]), lambda v: v.isNotNull() & (v != "")), ";")


def merged_clips(numbered: DataFrame, *by: str) -> DataFrame:
    """One row for each clip: window, and the merged fields of its events."""
    last = [c for c in LAST_OF if c in numbered.columns]
    fields = ["event_sec", "det_idx", "win_start", "win_end", "duration_sec", "method", "text", "scores", "target", "event_key", "event_weapon", "context_rule", "clip_before_sec", "clip_after_sec", *last]
    groups = numbered.groupBy(*by, "clip_idx").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))
    first, end = F.col("e")[0], F.element_at("e", -1)
    targets = F.array_distinct(F.filter(F.transform("e", lambda x: x["target"]), lambda v: v.isNotNull() & (v != "")))
    rules = _distinct_join("e", "context_rule", "+", "default")
    return groups.select(
        *by, "clip_idx", first["win_start"].alias("start_sec"), F.array_max(F.transform("e", lambda x: x["win_end"])).alias("end_sec"),
        first["duration_sec"].alias("duration_sec"), first["event_sec"].alias("event_sec"), F.size("e").cast("string").alias("event_count"),
        _distinct_join("e", "method", "+").alias("method"), _distinct_join("e", "text", " || ").alias("text"), _plain_join("e", "scores").alias("scores"),
        F.when(F.size(targets) == 1, targets[0]).otherwise(F.lit("both")).alias("merged_target"), _plain_join("e", "event_key").alias("event_key"),
        F.array_join(F.transform("e", lambda x: fixed3_of_ms(ms_key(x["event_sec"]))), ";").alias("event_secs"),
        _distinct_join("e", "event_weapon", ";").alias("event_weapon"), F.when(rules != "", rules).otherwise(F.lit("default")).alias("context_rule"),
        F.array_max(F.transform("e", lambda x: F.greatest(x["clip_before_sec"], F.lit(0.0)))).alias("clip_before_sec"),
        F.array_max(F.transform("e", lambda x: F.greatest(x["clip_after_sec"], F.lit(0.0)))).alias("clip_after_sec"),
        *[end[c].alias(c) for c in last],
    ).withColumnRenamed("merged_target", "target" if "target" not in by else "merged_target")


def planned_clips(kept: DataFrame, plan: Planning) -> DataFrame:
    """Clips of prepared detections, by source and, if targets are split, by target."""
    by = ["source_idx"]
    if plan.split_targets:
        kept, by = kept.filter(F.col("target").isin("self-death", "own-kill")), ["source_idx", "target"]
    return merged_clips(numbered_clips(with_windows(kept, plan), *by), *by)


def plan_clips(detections: DataFrame, plan: Planning) -> tuple[DataFrame, DataFrame]:
    """(clips, skipped) of detections, without regard to other sources."""
    kept, skipped = early(detections, plan)
    return planned_clips(with_context(kept, plan), plan), skipped


def with_sequence(clips: DataFrame) -> DataFrame:
    """``clip_seq`` from 1 over all clips in the order of sources and clips.

    Only counts of clips by source meet in one window; rows are numbered within their source.
    """
    counts = clips.groupBy("source_idx").agg(F.count("*").alias("_n"))
    spread = counts.withColumn("_part", F.floor(F.col("source_idx") / 4096))
    totals = spread.groupBy("_part").agg(F.sum("_n").alias("_m"))
    ahead = totals.withColumn("_ahead", F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    inside = Window.partitionBy("_part").orderBy("source_idx").rowsBetween(Window.unboundedPreceding, -1)
    base = (spread.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(ahead, "_part")
            .select("source_idx", (F.col("_in") + F.col("_ahead")).alias("_base")))
    own = F.row_number().over(Window.partitionBy("source_idx").orderBy("clip_idx"))
    return clips.join(base, "source_idx").withColumn("clip_seq", (F.col("_base") + own).cast("bigint")).drop("_base")


def output_label(seq: Column, target: Column, count: Column, name: Column) -> Column:
    """Clip file label: three-digit number, target with the count of events if more than one, and the recording."""
    times = F.when(count.cast("int") > 1, F.concat(F.lit("x"), count.cast("string"))).otherwise(F.lit(""))
    return F.format_string("%03d_%s%s_%s", seq, target, times, name)
