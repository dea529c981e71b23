"""Connected components of an edge table by alternating stars.

Large-star and small-star steps as published by Kiveris et al. (2014): every
step is one aggregation and one join keyed by a node, so no task ever needs a
whole component.  Each round is written to the shared folder, which cuts the
lineage and lets lost executors recompute one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .store import Kept, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    out = out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return out.distinct()


def _kept(edges: DataFrame, rows: int | None) -> tuple[Kept, tuple]:
    """The edges written, and what tells them from others: their number and the sum of their hashes, taken as they are written."""
    seen = Observation()
    table = keep(edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")), rows=rows)
    return table, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, a: str, b: str, rounds: int = 60, rows: int | None = None) -> Kept:
    """(node, component): the least node id that links reach, for every node on an edge.

    Nodes without edges are absent; null ends and loops are ignored; an empty
    edge table gives an empty result.  ``rows``, if known, is about how many edges
    there are.  Raises if the rounds run out.
    """
    clean = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, mark = _kept(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows)
    for _ in range(rounds):
        if not mark[0]:
            break
        half = keep(_star(now.df, large=True), rows=mark[0])
        now.drop()
        now, new = _kept(_star(half.df, large=False), mark[0])
        half.drop()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = keep(now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
               .union(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), rows=mark[0])
    now.drop()
    return out
