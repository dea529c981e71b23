"""Two runs side by side, and annotated samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text

FIELDS = ("action", "event_kind", "target")


def side_by_side(left: DataFrame, right: DataFrame, key: str = "frame_id") -> DataFrame:
    """One row for each id of either run; fields as ``l_`` and ``r_``, ``in_left`` and ``in_right``."""
    l = left.select(key, F.lit(True).alias("in_left"), *[F.col(c).alias(f"l_{c}") for c in left.columns if c != key])
    r = right.select(key, F.lit(True).alias("in_right"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    out = l.join(r, key, "full")
    return out.withColumn("in_left", F.coalesce("in_left", F.lit(False))).withColumn("in_right", F.coalesce("in_right", F.lit(False)))


def match_rates(both: DataFrame) -> DataFrame:
    """One row: frames, the share of equal texts and fields over all ids, boxes over comparable rows, mean gap of times, missing ids."""

    def rate(hit):
        return F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))

    def text(side):
        return normalize_text(F.coalesce(F.col(f"{side}_text"), F.lit("")))

    cols = set(both.columns)
    out = [F.count("*").alias("frames"), rate(text("l") == text("r")).alias("text_match_rate")]
    for f in FIELDS:
        if f"l_{f}" in cols:
            out.append(rate(F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}"))).alias(f"{f}_match_rate"))
    if "l_boxes" in cols:
        comparable = F.col("in_left") & F.col("in_right") & ((F.size("l_boxes") > 0) | (F.size("r_boxes") > 0))
        out += [F.count_if(comparable).alias("box_comparable_frames"), F.avg(F.when(comparable, F.col("l_boxes").eqNullSafe(F.col("r_boxes")).cast("double"))).alias("box_order_match_rate")]
    if "l_inference_ms" in cols:
        out.append(F.avg(F.abs(F.col("l_inference_ms") - F.col("r_inference_ms"))).alias("mean_inference_delta_ms"))
    out += [F.count_if(~F.col("in_left")).alias("n_missing_from_left"), F.count_if(~F.col("in_right")).alias("n_missing_from_right")]
    return both.agg(*out)


def missing_ids(a: DataFrame, b: DataFrame, key: str = "frame_id") -> DataFrame:
    """Ids of ``a`` that ``b`` lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def bound_once(frames: DataFrame, reference: DataFrame, key: str = "frame_id") -> DataFrame:
    """(key, n): how many reference rows each frame has, 1 where all is well; frames and reference rows without partner have 0."""
    counts = reference.groupBy(key).agg(F.count("*").alias("n_reference"))
    own = frames.groupBy(key).agg(F.count("*").alias("n_frames"))
    return own.join(counts, key, "full").select(key, F.coalesce("n_frames", F.lit(0)).alias("n_frames"), F.coalesce("n_reference", F.lit(0)).alias("n_reference"))


def classification_rate(rows: DataFrame, got: str, wanted: str) -> DataFrame:
    """Share of rows classed as wanted, and whether all are."""
    ok = F.col(got).eqNullSafe(F.col(wanted))
    return rows.agg(F.count("*").alias("frames"), F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("match_rate"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_ok"))


def stratified(samples: DataFrame, limit: int, kind: str = "event_kind", order: str = "ord") -> DataFrame:
    """Of each language and target at most max(limit/2, 1): assists and delayed eliminations first, then in input order."""
    rank = Window.partitionBy("language", "target").orderBy(~F.col(kind).isin("assist", "delayed-elimination"), order)
    return samples.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= max(limit // 2, 1)).drop("_r")


def event_signatures(events: DataFrame) -> DataFrame:
    """Events with digests in place of their subject, key and text."""
    return events.select(*[c for c in events.columns if c not in ("subject", "key", "event_text")], F.sha2("subject", 256).alias("subject_sha256"), F.sha2("key", 256).alias("key_sha256"), F.sha2("event_text", 256).alias("text_sha256"))
