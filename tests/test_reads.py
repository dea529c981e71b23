"""Budgets and spacing of reads against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from clipwright.operators import schedule

READS = "source_idx int, ms long, roi string, ord long"


def reads_of(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, None]), rng.randrange(60) * 250, rng.choice(["event", "assist"]), i) for i in rng.sample(range(10 * n), n)]


def outcomes_by_loop(rows, calls, interval):
    """The rules of a read, one after the other: cached, out of budget, too soon, made."""
    out, held = {}, {}
    for source, ms, roi, ord_ in sorted(rows, key=lambda r: r[3]):
        made, known, last = held.get(source, (0, set(), None))
        if (roi, ms) in known:
            out[ord_] = "cached"
        elif calls is not None and made >= calls:
            out[ord_] = "ocr-budget-exhausted"
        elif last is not None and abs(ms - last) < interval - 1e-3:
            out[ord_] = "ocr-min-interval"
        else:
            out[ord_] = "read"
            held[source] = (made + 1, known | {(roi, ms)}, ms)
    return out


@pytest.mark.parametrize("calls", [None, 0, 1, 25, 10_000])
@pytest.mark.parametrize("interval", [0, 900])
def test_ledger_like_a_loop(spark, calls, interval):
    rows = reads_of(1)
    df = spark.createDataFrame(rows, READS).repartition(3)
    out = schedule.ledger(df, calls, interval)
    assert {r["ord"]: r["outcome"] for r in out.collect()} == outcomes_by_loop(rows, calls, interval)
    assert out.columns == ["source_idx", "ms", "roi", "ord", "outcome"]


def test_one_budget_for_all_kinds(spark):
    """Refining and looking for assists after a scheduled read draw on what the later ones have."""
    seeds = spark.createDataFrame([(1, t) for t in (0, 4000, 8000)], "source_idx int, ms long")
    more = "source_idx int, seed_ms long, step int, ms long"
    refined = spark.createDataFrame([(1, 4000, 0, 2000), (1, 4000, 1, 3000), (1, 8000, 0, 4000)], more)
    assists = spark.createDataFrame([(1, 4000, 0, 4000), (1, 4000, 1, 4500)], more)
    joint = schedule.joint_reads(seeds, refined, assists)
    assert [(r["ms"], r["roi"], r["kind"]) for r in joint.orderBy("ord").collect()] == [(0, "event", "scheduled"), (4000, "event", "scheduled"), (2000, "event", "refine"), (3000, "event", "refine"), (4000, "assist", "assist"), (4500, "assist", "assist"), (8000, "event", "scheduled"), (4000, "event", "refine")]
    got = [r["outcome"] for r in schedule.ledger(joint, 5).orderBy("ord").collect()]
    assert got == ["read"] * 5 + ["ocr-budget-exhausted", "ocr-budget-exhausted", "cached"]
    assert schedule.within_budget(joint, 5).count() == 6
    with pytest.raises(ValueError):
        schedule.ledger(joint, -1)


def test_budget_has_no_window_over_a_source(spark):
    df = spark.range(5000).select(F.lit(1).alias("source_idx"), "id", F.lit("event").alias("roi"), F.col("id").alias("ord")).withColumnRenamed("id", "ms")
    out = schedule.ledger(df, 700)
    assert out.filter("outcome = 'read'").agg(F.count("*"), F.max("ord")).first() == (700, 699)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in line for line in plan.splitlines() if "Window [" in line)  # within ranges, or over their sums


def spaced_by_loop(rows, interval):
    out, last = set(), {}
    for source, ms in sorted({(s, m) for s, m in rows if m is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if source not in last or ms - last[source] >= interval:
            last[source] = ms
            out.add((source, ms))
    return out


@pytest.mark.parametrize("slot", [1, 500, 1000, 7777, 10**7])
@pytest.mark.parametrize("interval", [0, 1, 900, 5000])
def test_spacing_in_slots(spark, slot, interval):
    rng = random.Random(slot + interval)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([rng.randrange(-3000, 60_000), rng.randrange(40) * 450, None])) for _ in range(500)]
    got = schedule.spaced(spark.createDataFrame(rows, "source_idx int, ms long"), interval, slot).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == spaced_by_loop(rows, interval)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_spacing_over_many_tasks(spark, broadcast):
    """Whatever the join of the entries is, the rows of a slot are in one task."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7", "spark.sql.autoBroadcastJoinThreshold": broadcast}
    before = {k: spark.conf.get(k, None) for k in conf}
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(200) * 250) for _ in range(600)]
    df = spark.createDataFrame(rows, "source_idx int, ms long")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in schedule.spaced(df, 900, 4000).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted(spaced_by_loop(rows, 900))


def test_spacing_of_nothing(spark):
    assert schedule.spaced(spark.createDataFrame([], "source_idx int, ms long"), 900).collect() == []
    assert schedule.spaced(spark.createDataFrame([("a", 5), ("a", 6)], "source_idx string, ms long"), 2).collect() == [("a", 5)]


def refined_by_loop(hit, visible, before, stride, step):
    """Reads back from a hit, one after the other."""
    on, off, t = hit, None, hit - stride
    while t >= max(hit - before, 0):
        if t not in visible:
            off = t
            break
        on, t = t, t - stride
    while off is not None and on - off > step:
        middle = (on + off) // 2
        if middle in visible:
            on = middle
        else:
            off = middle
    return on


@pytest.mark.parametrize("before,stride,step", [(6000, 2000, 500), (6000, 1000, 500), (5000, 500, 500), (7000, 4000, 250)])
def test_refined_onsets_like_a_loop(spark, before, stride, step):
    rng = random.Random(stride)
    shown = sorted({(rng.choice([1, 1, 2]), rng.randrange(160) * 250, rng.choice("ab")) for _ in range(500)})
    hits = rng.sample(shown, 120) + [(9, 500, "a"), (1, 1, "a")]
    schema = "source_idx int, ms long, event_key string"
    got = {tuple(r)[:3]: r["onset_ms"] for r in schedule.refined_onsets(spark.createDataFrame(hits, schema), spark.createDataFrame(shown, schema), before, stride, step).collect()}
    want = {h: refined_by_loop(h[1], {m for s, m, k in shown if (s, k) == (h[0], h[2])}, before, stride, step) for h in hits}
    assert got == want and len({h[1] - o for h, o in want.items()}) > 3


def test_refined_onsets_check_their_grid(spark):
    df = spark.createDataFrame([(1, 5, "a")], "source_idx int, ms long, event_key string")
    for bad in ({"stride_ms": 1500}, {"step_ms": 0}, {"before_ms": 0}, {"before_ms": 10**6}):
        with pytest.raises(ValueError):
            schedule.refined_onsets(df, df, **bad)
