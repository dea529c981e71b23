"""Planning by request and answer lines: JSON documents in, JSON documents out.

A request line holds the detections of one source within one stretch of media
time, so that no line grows with a recording; a source may have any number of
lines in any order.  Answer lines hold the clips that start within a stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clips import SLOT_SEC, Planning, early, planned_clips, with_context

FIELDS = {"det_idx": "bigint", "duration_sec": "double", "event_sec": "double", "target": "string", "event_key": "string", "event_weapon": "string", "language": "string", "method": "string", "text": "string", "scores": "string"}
CLIP = {"clip_idx": "bigint", "start_sec": "double", "end_sec": "double", "event_sec": "double", "event_count": "string", "target": "string", "event_key": "string", "method": "string", "text": "string"}


def _schema(fields: dict[str, str]) -> str:
    return f"array<struct<{', '.join(f'{n}: {k}' for n, k in fields.items())}>>"


def request_lines(detections: DataFrame, stretch_sec: float = SLOT_SEC) -> DataFrame:
    """(source_idx, stretch, value): the detections of each stretch of a source as one JSON array; those without a time are a stretch of their own."""
    stretch = F.floor(F.col("event_sec") / stretch_sec)
    rows = detections.select("source_idx", stretch.alias("stretch"), F.struct(*[F.col(n).cast(k).alias(n) for n, k in FIELDS.items()]).alias("d"))
    return rows.groupBy("source_idx", "stretch").agg(F.to_json(F.array_sort(F.collect_list("d"))).alias("value"))


def answered(requests: DataFrame, plan: Planning, stretch_sec: float = SLOT_SEC) -> DataFrame:
    """(source_idx, stretch, value, bad): the clips that start in each stretch of a source as one JSON array in their order.

    The clips of a source do not depend on how its detections are dealt to
    lines.  A line that is no such array plans nothing and comes back as it is,
    with ``bad`` true: it must not pass for a source without clips.
    """
    parsed = requests.withColumn("d", F.from_json("value", _schema(FIELDS)))
    bad = parsed.filter("d is null").select("source_idx", "stretch", "value", F.lit(True).alias("bad"))
    rows = parsed.filter("d is not null").select("source_idx", F.explode("d").alias("d")).select("source_idx", "d.*")
    clips = planned_clips(with_context(early(rows, plan)[0], plan), plan)
    made = clips.select("source_idx", F.floor(F.col("start_sec") / stretch_sec).alias("stretch"), F.struct(*[F.col(n).cast(k).alias(n) for n, k in CLIP.items()]).alias("c"))
    good = made.groupBy("source_idx", "stretch").agg(F.to_json(F.array_sort(F.collect_list("c"))).alias("value")).withColumn("bad", F.lit(False))
    return good.unionByName(bad)


def answer_clips(answers: DataFrame) -> DataFrame:
    """(source_idx, c): the clips of answer lines."""
    return answers.filter("not bad").select("source_idx", F.explode(F.from_json("value", _schema(CLIP))).alias("c"))
