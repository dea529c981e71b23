"""The bounded, labelled sample that classifiers learn from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import mapped, texts_of


def remainder(doc_id: Column | str) -> Column:
    """crc32 of the id as text, mod 5; rows with remainder 0 are held out from learning."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int) -> tuple[pd.DataFrame, dict[int, int]]:
    """At most ``each`` learnable texts of either label, chosen by a hash of the id, and how many there are of each.

    The counts are of all learnable labels.  Labels that are null or neither 0
    nor 1 are passed over; an id labelled twice has its largest label, and one
    with several texts the first of them in string order.  Only the chosen
    texts, one for each id, come to the driver.
    """
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
              .filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y")).filter(remainder("doc_id") != 0))
    counts = {0: 0, 1: 0} | {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        chosen = part if chosen is None else chosen.union(part)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    got = plain.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.coalesce(F.min("text"), F.lit("")).alias("text"))  # at most 2 * each ids
    return got.toPandas().sort_values("doc_id", ignore_index=True), counts


def scored(docs: DataFrame, scorer, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; ``scorer`` maps texts to scores.  A null id is not held out."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": sent.value.scores([t or "" for t in texts_of(b)])}

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id").cast("long")) == 0, F.lit(False)).alias("held_out"), F.col("text").alias("text"))
    return mapped(plain, run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
