"""Reading order of recognised blocks, and the brightness gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROWS = "array<struct<at:int,h:int,blocks:array<struct<x1:int,y1:int,ord:int,text:string,score:double>>>>"


def assembled(blocks: DataFrame, *key: str) -> DataFrame:
    """Text of each frame from its blocks (x1, y1, x2, y2, text, score).

    Blocks go top down; one joins the first row whose anchor, the vertical
    centre of its first block, is at most half the smaller height away.  Rows
    are read by anchor, blocks within a row by their left edge.
    """
    one = F.struct("y1", "x1", "y2", F.col("text"), F.col("score").cast("double").alias("score"))
    rows = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("b"))
    fold = f"""
      aggregate(
        transform(b, (x, i) -> named_struct('at', int(x.y1 + greatest(x.y2 - x.y1, 1) div 2), 'h', int(greatest(x.y2 - x.y1, 1)),
                  'one', named_struct('x1', int(x.x1), 'y1', int(x.y1), 'ord', int(i), 'text', x.text, 'score', x.score))),
        cast(array() as {_ROWS}),
        (acc, x) -> if(exists(acc, r -> abs(x.at - r.at) <= least(x.h, r.h) div 2),
          transform(acc, (r, i) -> if(i = array_position(transform(acc, q -> abs(x.at - q.at) <= least(x.h, q.h) div 2), true) - 1,
            named_struct('at', r.at, 'h', r.h, 'blocks', concat(r.blocks, array(x.one))), r)),
          concat(acc, array(named_struct('at', x.at, 'h', x.h, 'blocks', array(x.one))))))
    """
    ordered = "transform(array_sort(transform(lines, (r, i) -> named_struct('at', r.at, 'i', i, 'blocks', array_sort(r.blocks)))), r -> r.blocks)"
    return (rows.withColumn("lines", F.expr(fold)).withColumn("lines", F.expr(ordered))
            .select(*key, F.expr("array_join(transform(lines, r -> array_join(transform(r, x -> x.text), ' ')), '\n')").alias("text"),
                    F.expr("flatten(transform(lines, r -> transform(r, x -> x.score)))").alias("scores"), F.expr("size(lines)").alias("n_rows")))


def passes_brightness(bright_px: Column, width: Column, height: Column) -> Column:
    """Enough bright pixels: at least 8 and at least a five-hundredth of the area."""
    return bright_px >= F.greatest(F.lit(8), F.floor(width * height * 0.002))
