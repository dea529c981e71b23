"""Clip numbering and requests for recordings too long for one task, against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from clipwright.operators import clips, requests

PLAN = clips.Planning(before=5.0, after=1.0, min_event=2.0, incendiary_before=None)
EVENTS = "source_idx int, det_idx int, duration_sec double, event_sec double, target string, event_key string, event_weapon string, language string, method string, text string, scores string"


def events_of(seed, n=500):
    """One source with most of the rows; windows that touch, cover each other and reach over many slots."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice([1, 1, 1, 1, 2, 3, None])
        sec = rng.choice([rng.uniform(0, 900), float(rng.randrange(900)), rng.randrange(150) * 6.0, None if rng.random() < 0.1 else 899.5])
        rows.append((source, i, 900.0, sec, rng.choice(["own-kill", "self-death"]), f"own-kill:eliminate:p{i}", f"w{i % 3}", "en", f"m{i % 2}", f"t{i % 5}", f"0.{i}"))
    return rows


def numbered_by_loop(rows, by):
    """det_idx -> (group, number)."""
    out, groups = {}, {}
    for r in sorted((r for r in rows if r["win_end"] is not None), key=lambda r: (r["event_sec"], r["det_idx"])):
        key = tuple(r[c] for c in by)
        reach, n = groups.get(key, (None, 0))
        if reach is None or r["win_start"] > reach + 1e-6:
            n += 1
        groups[key] = (r["win_end"] if reach is None else max(reach, r["win_end"]), n)
        out[r["det_idx"]] = (key, n)
    return out


@pytest.mark.parametrize("slot", [1.0, 7.0, 60.0, 3600.0])
@pytest.mark.parametrize("by", [("source_idx",), ("source_idx", "target")])
def test_clip_numbers_in_slots(spark, slot, by):
    # some windows reach far over the slots
    df = spark.createDataFrame(events_of(2), EVENTS).withColumn("clip_before_sec", F.when(F.col("det_idx") % 50 == 0, 300.0).otherwise(1.0)).withColumn("clip_after_sec", F.when(F.col("det_idx") % 37 == 0, 40.0).otherwise(0.5))
    windows = clips.with_windows(df, PLAN)
    rows = [r.asDict() for r in windows.collect()]
    got = {r["det_idx"]: (tuple(r[c] for c in by), r["clip_idx"]) for r in clips.numbered_clips(windows, *by, slot_sec=slot).collect()}
    assert got == numbered_by_loop(rows, by)


def test_no_task_holds_a_source(spark):
    """Rows are dealt by source and slot; what meets by source alone is a row for each slot."""
    df = spark.range(20_000).select(F.lit(1).alias("source_idx"), F.col("id").alias("det_idx"), (F.col("id") * 3.0).alias("event_sec"), F.lit(60_000.0).alias("duration_sec"), F.lit(1.0).alias("clip_before_sec"), F.lit(1.0).alias("clip_after_sec"))
    out = clips.numbered_clips(clips.with_windows(df, PLAN), "source_idx", slot_sec=600.0)
    assert out.agg(F.max("clip_idx"), F.count("*")).first() == (20_000, 20_000)
    dealt = clips.with_windows(df, PLAN).withColumn("_key", F.struct("source_idx", F.floor(F.col("event_sec") / 600.0)))
    assert dealt.groupBy("_key").count().agg(F.max("count")).first()[0] == 200
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window [" in line and "_key" not in line.split("windowspecdefinition")[1].split(",")[0]]
    assert whole and all("_n#" in line or "_end#" in line for line in whole)  # sums of summaries only


def clips_of(df):
    return sorted((r["source_idx"] if r["source_idx"] is not None else -1, r["clip_idx"], round(r["start_sec"], 6), round(r["end_sec"], 6), r["event_count"], r["event_key"]) for r in df.select("source_idx", "clip_idx", "start_sec", "end_sec", "event_count", "event_key").collect())


@pytest.mark.parametrize("stretch", [30.0, 3600.0])
def test_requests_in_lines(spark, stretch):
    df = spark.createDataFrame(events_of(3), EVENTS)
    want = clips_of(clips.planned_clips(clips.with_context(clips.early(df, PLAN)[0], PLAN), PLAN))
    lines = requests.request_lines(df, stretch)
    sizes = [len(json.loads(r["value"])) for r in lines.collect()]
    assert sum(sizes) == 500 and max(sizes) < 500 / (3 if stretch == 30.0 else 1)
    answers = requests.answered(lines.repartition(3), PLAN, stretch)
    assert clips_of(requests.answer_clips(answers).select("source_idx", "c.*")) == want
    for r in answers.collect():
        starts = [c["start_sec"] for c in json.loads(r["value"])]
        assert starts == sorted(starts) and all(int(s // stretch) == r["stretch"] for s in starts)


def test_bad_requests_come_back(spark):
    df = spark.createDataFrame(events_of(4, 20), EVENTS)
    bad = spark.createDataFrame([(9, 0, "not json"), (9, 1, None), (8, 0, "[]")], "source_idx int, stretch long, value string")
    answers = requests.answered(requests.request_lines(df).unionByName(bad), PLAN)
    assert {(r["source_idx"], r["stretch"], r["value"]) for r in answers.filter("bad").collect()} == {(9, 0, "not json"), (9, 1, None)}
    assert answers.filter("source_idx = 8").count() == 0
    assert clips_of(requests.answer_clips(answers).select("source_idx", "c.*")) == clips_of(clips.planned_clips(clips.with_context(clips.early(df, PLAN)[0], PLAN), PLAN))
