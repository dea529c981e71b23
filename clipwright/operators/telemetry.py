"""Sums, rates and histograms of runs; retention of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

SECONDS = ("detect_seconds", "ocr_seconds", "ocr_frame_seconds", "refine_ocr_seconds", "assist_ocr_seconds")
COUNTS = ("ocr_requests", "ocr_successes", "ocr_skipped", "ocr_cache_hits", "refine_calls", "assist_calls")


def current_telemetry(work: DataFrame) -> DataFrame:
    """One row of sums over the sources scanned now."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum" if c in SECONDS else c) for c in (*SECONDS, *COUNTS) if c in work.columns]
    return work.agg(F.count("*").alias("sources"), *sums)


def historical_telemetry(snapshots: DataFrame, source: str = "source_idx") -> DataFrame:
    """Sums over sources of their largest snapshot; a source without any telemetry is counted apart."""
    fields = [c for c in (*SECONDS, *COUNTS) if c in snapshots.columns]
    each = snapshots.groupBy(source).agg(*[F.max(c).alias(c) for c in fields])
    empty = F.lit(True)
    for c in fields:
        empty = empty & F.col(c).isNull()
    return each.agg(F.count("*").alias("sources"), F.count_if(empty).alias("sources_without_telemetry"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum" if c in SECONDS else c) for c in fields])


def cache_rate(lookups: DataFrame, status: str = "cache_status") -> DataFrame:
    hits, misses = F.count_if(F.col(status) == "hit"), F.count_if(F.col(status) == "miss")
    return lookups.agg(hits.alias("hits"), misses.alias("misses")).withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(F.lit(0.0)))


def phase_seconds(marks: DataFrame) -> DataFrame:
    """(run_id, phase, seconds) of ``marks`` (run_id, seq, ts_ms, phase): each phase lasts until the next mark."""
    order = Window.partitionBy("run_id").orderBy("seq")
    gaps = marks.withColumn("ms", F.lead("ts_ms").over(order) - F.col("ts_ms"))
    return gaps.groupBy("run_id", "phase").agg((F.coalesce(F.sum("ms"), F.lit(0)) / 1000).alias("seconds"))


def sample_stats(samples: DataFrame, by: str, repeat: str, value: str, bad: str) -> DataFrame:
    """Samples, bad ones, total, mean, median and the value nine tenths up; and the repeat with the least total.

    Ranks are exact, see ``ranks``; the counts are of all samples, the ranks of
    those with a value.
    """
    each = samples.groupBy(by, repeat).agg(F.sum(value).alias("t"))
    best = each.groupBy(F.col(by).alias("_of")).agg(F.min_by(repeat, F.struct("t", repeat)).alias("best_repeat"))
    base = samples.groupBy(by).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    found = ranks(samples, by, value, lambda n: {"lo": F.floor((n - 1) / 2) + 1, "hi": F.floor(n / 2) + 1, "p90": F.least(F.floor(n * 9 / 10) + 1, n)})
    stats = base.join(found, base[by].eqNullSafe(found["_of"]), "left").drop("_of").withColumn("median", (F.col("lo") + F.col("hi")) / 2).drop("lo", "hi")
    return stats.join(best, stats[by].eqNullSafe(best["_of"])).drop("_of")


def ranks(rows: DataFrame, by: str, value: str, asked: Callable[[Column], dict[str, Column]], parts: int = 200) -> DataFrame:
    """(_of, a column for each asked rank): of each group ``by`` the values of exact ranks from 1, asked given its number of values.

    Approximate quantiles of a group bracket each asked rank; values are dealt
    to the few ranges between these marks, counted, and only ranges that hold
    an asked rank are shuffled by value and put in order, so no task sees all
    of a group.  The marks decide how long a range is, not what is found.
    Nulls are no values.
    """
    values = rows.filter(F.col(value).isNotNull()).select(F.col(by).alias("_of"), F.col(value).alias("_v"))
    cuts = values.groupBy("_of").agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], parts * 20).alias("_cuts"), F.count("*").alias("_n"))
    wanted = asked(F.col("_n"))
    at = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("long").alias("r")) for k, v in wanted.items()])
    place = F.transform(at, lambda x: F.floor(x["r"] * parts / F.col("_n")).cast("int"))
    near = F.flatten(F.transform(place, lambda i: F.array(*[F.get("_cuts", i + F.lit(d)) for d in (-3, 1)])))
    # written, so that a few groups are known to be few before the values are moved
    marks = written(cuts.select(F.col("_of").alias("_g"), "_n", F.array_distinct(F.filter(near, lambda x: x.isNotNull())).alias("_marks")))
    dealt = values.join(marks, F.col("_of").eqNullSafe(F.col("_g"))).withColumn("_part", F.size(F.filter("_marks", lambda x: x < F.col("_v"))))
    sizes = dealt.groupBy("_of", "_n", "_part").agg(F.count("*").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = sizes.withColumn("_before", before).withColumn("_ask", F.filter(at, lambda x: (x["r"] > F.col("_before")) & (x["r"] <= F.col("_before") + F.col("_s")))).filter(F.size("_ask") > 0)
    held = written(held.select(F.col("_of").alias("_h"), F.col("_part").alias("_p"), "_before", "_ask"))
    inside = dealt.join(held, F.col("_of").eqNullSafe(F.col("_h")) & (F.col("_part") == F.col("_p"))).groupBy("_of", "_part", "_v").agg(F.count("*").alias("_c"), F.first("_before").alias("_before"), F.first("_ask").alias("_ask"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_of", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = inside.withColumn("_upto", upto).select("_of", "_v", "_c", "_upto", F.explode("_ask").alias("_a")).filter("_a.r <= _upto and _a.r > _upto - _c")
    return placed.groupBy("_of").agg(*[F.max(F.when(F.col("_a.k") == k, F.col("_v"))).alias(k) for k in wanted])


def codec_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("codec", F.lit("unknown")).alias("codec")).agg(F.count("*").alias("n"))


def run_summary(records: DataFrame) -> DataFrame:
    """One row: included, skipped (unreadable among them), unreadable, and counts by method, detector, encoder and end."""
    status = F.col("Status")
    base = records.agg(F.count_if(status == "included").alias("included"), F.count_if(status != "included").alias("skipped"), F.count_if(status == "unreadable").alias("unreadable"))
    for name in ("Method", "Detector", "Encoder", "TerminationReason"):
        if name in records.columns:
            n = records.groupBy(F.coalesce(name, F.lit("")).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(f"{name.lower()}_counts"))
            base = base.join(F.broadcast(n), how="cross")  # one row each
    return base


def outcome(failed: Column, cancelled: Column, included: Column, total: Column, unreadable: Column) -> Column:
    """How a run ended."""
    return (F.when(cancelled, F.lit("cancelled")).when(failed, F.lit("failed")).when((total > 0) & (unreadable == total), F.lit("all-unreadable"))
            .when(included == 0, F.lit("no-events")).when(unreadable > 0, F.lit("partial-success")).otherwise(F.lit("success")))


def stored_bytes(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Bytes and files by the first part of their paths."""
    return files.groupBy(F.substring_index(path, "/", 1).alias("group")).agg(F.sum(size).alias("bytes"), F.count("*").alias("files"))


def largest(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *ties).limit(k)


def within_size_budget(files: DataFrame, budget: int, size: str = "size", order: str = "mtime", spread: int | None = None) -> DataFrame:
    """The newest files whose sizes together stay within ``budget``; older ones are evicted, those without a time first.

    Sizes before a file are summed in two steps: over ``spread`` ranges of the
    order, one for about every 100,000 files if not given, cut at its
    approximate quantiles, and within them, so no task sorts all files.  Files
    of one time are in one range.
    """
    parts = spread or max(2, min(10_000, -(-files.count() // 100_000)))
    cuts = files.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], parts * 20).alias("_cuts"))  # one row
    at = F.col(order)
    rows = files.join(F.broadcast(cuts), how="cross").withColumn("_part", F.when(at.isNull(), F.lit(-1)).otherwise(F.size(F.filter("_cuts", lambda x: x < at)))).drop("_cuts")
    sizes = rows.groupBy("_part").agg(F.sum(size).alias("_s"))
    newer = sizes.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    own = F.sum(size).over(Window.partitionBy("_part").orderBy(at.desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(newer, "_part").withColumn("_total", F.col("_before") + own).filter(F.col("_total") <= budget).drop("_part", "_before", "_total")


def throughput(runs: DataFrame, by: str) -> DataFrame:
    """Share of time verifying, clips and media seconds by second of wall time, and the median speed-up over the baseline run, an exact rank."""
    wall = F.sum("wall_s")
    rates = runs.groupBy(by).agg((F.sum("verify_s") / F.sum("task_s")).alias("verify_share"), (F.sum("clips") / wall).alias("clips_per_s"), (F.sum("media_s") / wall).alias("media_s_per_s"))
    gains = runs.select(by, (F.col("baseline_s") / F.col("wall_s")).alias("_gain"))
    middle = ranks(gains, by, "_gain", lambda n: {"_lo": F.floor((n - 1) / 2) + 1, "_hi": F.floor(n / 2) + 1})
    joined = rates.join(middle, rates[by].eqNullSafe(middle["_of"]), "left")
    return joined.select(*rates.columns, ((F.col("_lo") + F.col("_hi")) / 2).alias("median_speedup"))
