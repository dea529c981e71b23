"""Report rows: one for each unreadable source, skipped detection and clip, and their candidate view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed3
from ..functions.text import first_score

#: The columns of the two reports, in order.
RECORD_COLUMNS = (
    "Index Name Target DurationSec Status EventSec EventSecs EventCount EventKeys EventWeapon ContextRule BeforeSec AfterSec KeepStartSec KeepEndSec KeepDurationSec Method Detector PaddleText PaddleScores "
    "OcrSeconds SampledFrames DetectSeconds OcrFrameSeconds OcrCoarseFrames OcrRefineFrames OcrGateSkippedFrames OcrGateReason OcrRequests OcrSuccesses OcrCacheHits OcrSkipped RefineBudgetUsed "
    "AssistBudgetUsed TerminationReason RefineOcrSeconds AssistOcrSeconds ProbeSeconds TrimSeconds TotalSeconds Encoder Output"
).split()
CANDIDATE_COLUMNS = (
    "SchemaVersion RunId Name Status Target StartSec EndSec EventSec EventSecs Score GateStatus GateReason SamplingDensity SampledFrames OcrRequests OcrSuccesses OcrSkipped OcrCacheHits OcrCoarseFrames "
    "OcrRefineFrames RefineBudgetUsed AssistBudgetUsed RefineOcrSeconds AssistOcrSeconds CacheStatus TerminationReason Method Detector"
).split()
_SECONDS = {"OcrSeconds": "ocr_seconds", "DetectSeconds": "detect_seconds", "OcrFrameSeconds": "ocr_frame_seconds", "RefineOcrSeconds": "refine_ocr_seconds", "AssistOcrSeconds": "assist_ocr_seconds",
            "ProbeSeconds": "probe_seconds", "TrimSeconds": "trim_seconds", "TotalSeconds": "total_seconds"}
_COUNTS = {"SampledFrames": "sampled_count", "OcrCoarseFrames": "ocr_coarse_frames", "OcrRefineFrames": "ocr_refine_frames", "OcrGateSkippedFrames": "ocr_gate_skipped_frames", "OcrRequests": "ocr_requests",
           "OcrSuccesses": "ocr_successes", "OcrCacheHits": "ocr_cache_hits", "OcrSkipped": "ocr_skipped", "RefineBudgetUsed": "refine_budget_used", "AssistBudgetUsed": "assist_budget_used"}
_TEXTS = {"Target": "target", "EventSecs": "event_secs", "EventKeys": "event_key", "EventWeapon": "event_weapon", "ContextRule": "context_rule", "PaddleText": "text", "PaddleScores": "scores",
          "OcrGateReason": "gate_reason", "TerminationReason": "termination_reason", "Encoder": "encoder", "Output": "output"}


def seconds_text(x: Column) -> Column:
    """Three decimals of the exact value of a number of seconds; null gives the empty text."""
    return F.coalesce(fixed3(x), F.lit(""))


def _records(df: DataFrame, status: str, given: dict[str, Column]) -> DataFrame:
    """All report columns of ``df``: given ones, else those it has, else zero or empty."""
    have = set(df.columns)
    out = {"Index": F.col("source_idx").cast("string"), "Name": F.col("name"), "DurationSec": seconds_text(F.col("duration_sec")), "Status": F.lit(status), "EventCount": F.lit("0")}
    for names, zero, make in ((_SECONDS, "0.000", seconds_text), (_COUNTS, "0", lambda c: c.cast("string")), (_TEXTS, "", lambda c: F.coalesce(c, F.lit("")))):
        out |= {k: make(F.coalesce(F.col(c), F.lit(0))) if c in have and zero else make(F.col(c)) if c in have else F.lit(zero) for k, c in names.items()}
    for k, c in (("Method", "method"), ("Detector", "detector")):
        out[k] = F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    out |= given
    order = [c for c in ("source_idx", "class", "ordinal") if c in have]
    return df.select(*order, *[out.get(k, F.lit("")).alias(k) for k in RECORD_COLUMNS])


def blank_records(sources: DataFrame, status: str) -> DataFrame:
    """Sources that gave nothing, such as unreadable ones (source_idx, name, duration_sec, method, detector)."""
    empty = {k: F.lit("") for k in _TEXTS}
    zero = {k: F.lit("0.000") for k in _SECONDS} | {k: F.lit("0") for k in _COUNTS}
    return _records(sources, status, empty | zero)


def skipped_records(skipped: DataFrame) -> DataFrame:
    given = {"EventSec": seconds_text(F.col("event_sec")), "EventCount": F.when(F.col("event_sec").isNotNull(), F.coalesce("event_count", F.lit("1"))).otherwise(F.lit("0"))}
    for k, c in (("BeforeSec", "clip_before_sec"), ("AfterSec", "clip_after_sec")):
        given[k] = F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, seconds_text(F.col(c))).otherwise(F.lit(""))
    return _records(skipped, "skipped", given)


def included_records(clips: DataFrame) -> DataFrame:
    at = seconds_text(F.col("event_sec"))
    given = {
        "EventSec": at, "EventCount": F.col("event_count"), "EventSecs": F.when(F.coalesce("event_secs", F.lit("")) != "", F.col("event_secs")).otherwise(at),
        "BeforeSec": seconds_text(F.greatest("clip_before_sec", F.lit(0.0))), "AfterSec": seconds_text(F.greatest("clip_after_sec", F.lit(0.0))),
        "KeepStartSec": seconds_text(F.col("start_sec")), "KeepEndSec": seconds_text(F.col("end_sec")), "KeepDurationSec": seconds_text(F.col("end_sec") - F.col("start_sec")),
    }
    return _records(clips, "included", given)


def in_order(*parts: DataFrame) -> DataFrame:
    """Records of one run: by source, in it early skips, then duplicates, then clips; parts come in that order."""
    out = None
    for i, part in enumerate(parts):
        now = part.withColumn("class", F.lit(i))
        out = now if out is None else out.unionByName(now, allowMissingColumns=True)
    return out.orderBy("source_idx", "class", "ordinal")


def density(coarse: Column, refine: Column) -> Column:
    return F.when(coarse + refine == 0, F.lit("none")).when(refine > 0, F.lit("dense")).otherwise(F.lit("coarse"))


def gate_status(reason: Column, skipped: Column) -> Column:
    return F.when(reason == "disabled", F.lit("disabled")).when(~skipped.isin("", "0"), F.lit("skipped")).otherwise(F.lit("passed"))


def candidate_records(records: DataFrame, run_id: str, cache: DataFrame | None = None) -> DataFrame:
    """Records with an event in the candidate columns; ``cache`` (Name, CacheStatus) defaults to a miss."""
    rows = records.filter(F.coalesce("EventSec", F.lit("")) != "")
    rows = rows.join(cache, "Name", "left") if cache is not None else rows.withColumn("CacheStatus", F.lit(None).cast("string"))

    def number(c: str) -> Column:
        return F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0))

    made = {
        "SchemaVersion": F.lit("1"), "RunId": F.lit(run_id), "StartSec": F.col("KeepStartSec"), "EndSec": F.col("KeepEndSec"), "Score": first_score(F.col("PaddleScores")), "GateReason": F.col("OcrGateReason"),
        "CacheStatus": F.coalesce("CacheStatus", F.lit("miss")), "SamplingDensity": density(number("OcrCoarseFrames"), number("OcrRefineFrames")),
        "GateStatus": gate_status(F.col("OcrGateReason"), F.col("OcrGateSkippedFrames")),
    }
    return rows.select(*[made.get(k, F.col(k) if k in rows.columns else F.lit("")).alias(k) for k in CANDIDATE_COLUMNS])


def value_counts(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(F.coalesce(field, F.lit("")).alias(field)).agg(F.count("*").alias("n"))


def source_total(df: DataFrame, field: str, name: str = "Name") -> DataFrame:
    """Sum over sources of the largest value of each; values that are no numbers count as 0."""
    number = F.greatest(F.coalesce(F.expr(f"try_cast({field} as double)"), F.lit(0.0)), F.lit(0.0))
    return df.groupBy(name).agg(F.max(number).alias("v")).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))
