"""The same event seen by several recordings: the one with the most context keeps it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def available_context() -> Column:
    """Seconds of the wanted window that the recording has."""
    return F.least(F.col("event_sec"), F.col("clip_before_sec")) + F.least(F.col("duration_sec") - F.col("event_sec"), F.col("clip_after_sec"))


def ranked(detections: DataFrame) -> DataFrame:
    """``winner``: the source that keeps the row's event; null for rows without time or key, which are no candidates."""
    candidate = F.col("event_sec").isNotNull() & (F.coalesce("event_key", F.lit("")) != "")
    best = winners(detections).withColumnsRenamed({"target": "_target", "event_key": "_key"})
    same = candidate & F.col("target").eqNullSafe(F.col("_target")) & (F.col("event_key") == F.col("_key"))
    return detections.withColumn("context", available_context()).join(best, same, "left").drop("_target", "_key")


def winners(detections: DataFrame) -> DataFrame:
    """(target, event_key, winner) by a partial aggregate, for keys that a window would hold in one task."""
    has = F.col("event_sec").isNotNull() & (F.coalesce("event_key", F.lit("")) != "")
    order = F.struct(available_context().isNull(), -available_context(), F.col("source_idx"), F.col("det_idx"))
    return detections.filter(has).groupBy("target", "event_key").agg(F.min_by("path", order).alias("winner"))


def with_duplicates(detections: DataFrame) -> DataFrame:
    """``duplicate``: another source keeps this event.  Hot keys are combined before the shuffle and their join split."""
    rows = detections.join(winners(detections), ["target", "event_key"], "left")
    candidate = F.col("event_sec").isNotNull() & (F.coalesce("event_key", F.lit("")) != "")
    return rows.withColumn("duplicate", F.coalesce(candidate & (F.col("path") != F.col("winner")), F.lit(False)))


def without_duplicates(detections: DataFrame) -> DataFrame:
    return with_duplicates(detections).filter(~F.col("duplicate")).drop("duplicate", "winner")


def dedupe_work(marked: DataFrame) -> DataFrame:
    """Candidates, comparisons and duplicates; each duplicate falls at its first comparison."""
    candidate = F.col("event_sec").isNotNull() & (F.coalesce("event_key", F.lit("")) != "")
    dup = F.count_if("duplicate")
    return marked.agg(F.count_if(candidate).alias("candidates"), dup.alias("pair_comparisons"), dup.alias("duplicates"))
