"""Stateful streams: the same answers as the batch forms, over several micro-batches and restarts."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clipwright.operators import lifecycle
from clipwright.streaming import jobs

#: (lines of (seq, current, total), last valid state): fixed cases of the progress rules.
REDUCED = [
    ([], None),
    ([(1, 10, 40)], (1, 10, 40)),
    ([(1, 10, 40), (2, 50, None)], (1, 10, 40)),  # the inherited total is checked too
    ([(1, 10, 40), (2, None, 5)], (1, 10, 40)),
    ([(1, 10, 40), (2, None, 10)], (2, 10, 10)),
    ([(1, 10, None)], None),  # nothing inherited yet: 10 of 0
    ([(1, None, None)], (1, 0, 0)),
    ([(1, None, 7), (2, 3, None)], (2, 3, 7)),
    ([(1, 1, 5), (2, 9, 5), (3, 5, 5)], (3, 5, 5)),
    ([(2, 2, 4), (1, 1, 4)], (2, 2, 4)),  # out of place
    ([(1, 3, 3), (1, 1, 3)], (1, 3, 3)),
]


@pytest.mark.parametrize("lines,want", REDUCED)
def test_reduced(lines, want):
    assert jobs.reduced(lines) == want


def progress_rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.randrange(4), rng.choice(["scan", "trim", "merge", "planning", "later"]), i, rng.choice([None, rng.randrange(12), -1 if rng.random() < 0.1 else 3]), rng.choice([None, rng.randrange(12)])) for i in range(n)]


LINES = "run_id long, phase string, seq long, current long, total long"


def plain_states(rows):
    held = {}
    for run, phase, seq, current, total in rows:
        if phase not in ("scan", "dedupe", "trim", "merge") or (current or 0) < 0:
            continue
        _, c, t = held.get((run, phase), (None, 0, 0))
        c, t = c if current is None else current, t if total is None else total
        if c <= t:
            held[run, phase] = (seq, c, t)
    return {k: (*v, k[1] == "scan" and v[1] == v[2]) for k, v in held.items()}


def states(df):
    return {(r["run_id"], r["phase"]): (r["seq"], r["current"], r["total"], r["done"]) for r in df.collect()}


def last_states(df):
    return states(df.groupBy("run_id", "phase").agg(F.max_by(F.struct("seq", "current", "total", "done"), "seq").alias("s")).select("run_id", "phase", "s.*"))


def parts_of(spark, folder, rows, schema, cuts):
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("seed", [1, 2])
def test_progress_table_like_a_loop(spark, seed):
    rows = progress_rows(seed)
    assert states(jobs.progress_table(spark.createDataFrame(rows, LINES).repartition(5))) == plain_states(rows)
    assert states(jobs.progress_table(spark.createDataFrame([], LINES))) == {}


def test_progress_lines_in_several_chunks():
    """The rows of a key come in chunks in any order."""
    p, held = jobs._Progress(), {}
    p.last = SimpleNamespace(exists=lambda: "s" in held, get=lambda: held["s"], update=lambda s: held.update(s=s))
    frames = [pd.DataFrame({"seq": s, "current": c, "total": t}) for s, c, t in (([5, 6], [4, 9], [8, None]), ([1, 2], [1.0, None], [3, 3]), ([3], [2], [3]))]
    out = pd.concat(p.handleInputRows((7, "scan"), iter(frames), None))
    assert out.values.tolist() == [[7, "scan", 5, 4, 8]] and held["s"] == (5, 4, 8)
    assert list(p.handleInputRows((7, "scan"), iter(frames[1:]), None)) == []  # nothing later than what is known


def run_once(spark, stream, folder, mode):
    """Drain what is there, from the checkpoint on."""
    with jobs.typed_state(spark):
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_progress_stream_over_batches_and_a_restart(spark, tmp_path):
    rows = progress_rows(3)
    (tmp_path / "in").mkdir()
    stream = jobs.progress_stream(spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    parts_of(spark, tmp_path / "in", rows, LINES, [0, 90, 200])
    assert last_states(run_once(spark, stream, tmp_path, "update")) == plain_states(rows[:200])
    parts_of(spark, tmp_path / "in", rows, LINES, [200, 400])
    assert last_states(run_once(spark, stream, tmp_path, "update")) == plain_states(rows)


EVENTS = "source_idx long, target string, ms long, ord int, action string, subject string, key string, name string, actor string, weapon string, method string, event_text string, assisted boolean"


def noisy_events(seed, n=240):
    rng = random.Random(seed)
    bases, rows = ["[ABC]Hunter77", "Sniper_Wolf", "noob12345", "李小龙玩家", "xXshadowXx"], []
    for i in range(n):
        chars = list(rng.choice(bases))
        if rng.random() < 0.6:
            chars[rng.randrange(len(chars))] = rng.choice("aZ9_")
        name = "".join(chars[: rng.choice([len(chars), len(chars), len(chars) - 2, 6])])
        target, action = rng.choice(["own-kill", "own-kill", "self-death"]), rng.choice(["knock", "eliminate"])
        rows.append((1 + i % 3, target, i * 100 + rng.randrange(100), rng.randrange(2), action, name, f"{target}:{action}:{name}", name, name, "", "", "", rng.random() < 0.2))
    return rows


def test_lifecycle_stream_like_the_batch_form(spark, tmp_path):
    """Noisy names over four micro-batches and a restart between them."""
    rows = noisy_events(5)
    (tmp_path / "in").mkdir()
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = jobs.lifecycle_stream(raw.withColumn("at", F.timestamp_millis("ms")))

    def plain(df):
        return sorted((r["source_idx"], r["target"], r["ms"], r["key"], r["decision"]) for r in df.select("source_idx", "target", "ms", "key", "decision").collect())

    parts_of(spark, tmp_path / "in", rows, EVENTS, [0, 70, 130])
    assert plain(run_once(spark, stream, tmp_path, "append")) == plain(lifecycle.decided(spark.createDataFrame(rows[:130], EVENTS)))
    parts_of(spark, tmp_path / "in", rows, EVENTS, [130, 131, 240])
    got = plain(run_once(spark, stream, tmp_path, "append"))
    assert got == plain(lifecycle.decided(spark.createDataFrame(rows, EVENTS)))
    assert len({r[4] for r in got}) >= 4


def test_lifecycle_forgets_after_silence(spark, tmp_path):
    """An hour after a source's last event its state goes, so the key is new again; a source still heard keeps its own."""
    hour, day = 3_600_000, 86_400_000
    made = [(s, day + ms) for s, ms in ((1, 0), (2, 0), (2, hour // 2), (3, 3 * hour), (3, 3 * hour + 60_000), (1, 3 * hour + 120_000))]
    rows = [(s, "own-kill", ms, 0, "knock", "n", "own-kill:knock:n", "n", "n", "", "", "", None) for s, ms in made]
    (tmp_path / "in").mkdir()
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    parts_of(spark, tmp_path / "in", rows, EVENTS, [0, 3, 4, 5, 6])
    out = run_once(spark, jobs.lifecycle_stream(raw.withColumn("at", F.timestamp_millis("ms"))), tmp_path, "append")
    assert sorted((r["source_idx"], r["ms"], r["decision"]) for r in out.collect()) == [(1, day, "kept"), (1, made[5][1], "kept"), (2, day, "kept"), (2, made[2][1], "repeat"), (3, made[3][1], "kept"), (3, made[4][1], "repeat")]


def test_streams_from_media_time_zero(spark, tmp_path):
    """Events at 0 and before it are not late in the first micro-batch."""
    rows = [(1, "own-kill", ms, i, "knock", "n", f"own-kill:knock:{i}", f"n{i}", "n", "", "", "", None) for i, ms in enumerate([0, -5, 1, 0, 7000])]
    (tmp_path / "in").mkdir()
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_millis("ms"))
    parts_of(spark, tmp_path / "in", rows, EVENTS, [0, 4, 5])
    keys = sorted(r[6] for r in rows)
    for name, stream in (("life", jobs.lifecycle_stream(raw)), ("first", jobs.without_repeats(raw.withColumn("event_key", F.col("key")), "at"))):
        assert sorted(r["key"] for r in run_once(spark, stream, tmp_path / name, "append").collect()) == keys


def test_late_rows_of_every_report():
    """More reports than Spark keeps."""
    listener = jobs.LateRows()
    for i in range(250):
        listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(id="q", stateOperators=[SimpleNamespace(numRowsDroppedByWatermark=i), SimpleNamespace(numRowsDroppedByWatermark=1)])))
    assert listener.by_query["q"] == sum(range(250)) + 250


def test_late_rows_over_many_batches(spark, tmp_path):
    """A watermark a day on, then 104 batches with one late row each."""
    day = 86_400
    for i in range(106):
        spark.createDataFrame([(i, day * 3 if i < 2 else 5)], "source_idx int, at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("source_idx int, at int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = jobs.without_repeats(raw.select("source_idx", F.lit("t").alias("target"), F.lit("k").alias("event_key"), F.timestamp_seconds("at").alias("ts")), "ts")
    sink = rows.coalesce(1).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, _: b.write.format("noop").mode("overwrite").save())
    assert jobs.late_rows(spark, sink.start) == 104


def test_progress_of_neighbouring_runs_shares_calls(spark, tmp_path):
    """Many runs: the states of a loop, over two batches, with a call for each group of neighbouring runs."""
    rng = random.Random(9)
    rows = [(run, seq, rng.choice(["scan", "trim"]), rng.choice([None, rng.randrange(20)]), rng.choice([None, rng.randrange(20)])) for seq in range(4) for run in range(-40, 300)]
    schema = "run_id long, seq long, phase string, current long, total long"
    (tmp_path / "in").mkdir()
    parts_of(spark, tmp_path / "in", rows, schema, [0, 700, len(rows)])
    stream = jobs.progress_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    got = run_once(spark, stream, tmp_path, "update").groupBy("run_id", "phase").agg(F.max(F.struct("seq", "current", "total")).alias("s")).collect()
    lines = {}
    for run, seq, phase, current, total in rows:
        lines.setdefault((run, phase), []).append((seq, current, total))
    want = {at: state for at, of in lines.items() if (state := jobs.reduced(of)) is not None}
    assert {(r["run_id"], r["phase"]): tuple(r["s"]) for r in got} == want
    assert stream._jdf.queryExecution().analyzed().toString().count("runs#") > 0  # grouped by neighbouring runs


def test_progress_keeps_runs_apart():
    p, held = jobs._Runs(), {}
    p.last = SimpleNamespace(exists=lambda: "s" in held, get=lambda: held["s"], update=lambda s: held.update(s=s))
    frame = pd.DataFrame({"run_id": [3, 2, 3, 3], "phase": ["scan", "scan", "trim", "scan"], "seq": [2, 1, 1, 1], "current": [None, 1, 2, 4], "total": [5, 1, 1, 4]})
    assert sorted(pd.concat(p.handleInputRows((0,), iter([frame[:2], frame[2:]]), None)).values.tolist()) == [[2, "scan", 1, 1, 1], [3, "scan", 2, 4, 5]]
    assert list(p.handleInputRows((0,), iter([frame]), None)) == [] and len(held["s"][0]) == 2


def test_lifecycle_of_neighbouring_sources_shares_a_call():
    """One call and one timer for several sources and targets; each keeps its own sightings and is forgotten at its own end."""
    life, held, timers = jobs._Lifecycle(1000), {"shown": []}, set()
    shown = SimpleNamespace(get=lambda: iter(held["shown"]), appendList=held["shown"].extend, put=lambda rows: held.update(shown=list(rows)), clear=lambda: held.update(shown=[]))
    ends = SimpleNamespace(exists=lambda: "ends" in held, get=lambda: held["ends"], update=lambda e: held.update(ends=e), clear=lambda: held.pop("ends", None))
    life.init(SimpleNamespace(getListState=lambda *a: shown, getValueState=lambda *a: ends, listTimers=lambda: iter(sorted(timers)), deleteTimer=timers.remove, registerTimer=timers.add))

    def call(rows, watermark):
        shown.appendList = held["shown"].extend
        frame = pd.DataFrame([(s, t, ms, i, "knock", "k", "name", "name", False, pd.Timestamp(ms, unit="ms")) for i, (s, t, ms) in enumerate(rows)], columns=["source_idx", "target", "ms", "ord", "action", "key", "name", "actor", "assisted", "at"])
        return [r[-1] for r in pd.concat(life.handleInputRows((0,), iter([frame[:1], frame[1:]]), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark))).values.tolist()]

    assert call([(1, "own-kill", 100), (2, "own-kill", 200), (1, "self-death", 300), (2, "own-kill", 400)], 0) == ["kept", "kept", "kept", "repeat"]
    assert timers == {1100} and len(held["ends"][0]) == 3
    assert call([(2, "own-kill", 1250)], 1200) == ["repeat"]  # source 1 has been silent too long, but not its deaths
    assert timers == {1300} and {r[:2] for r in held["ends"][0]} == {(1, "self-death"), (2, "own-kill")}
    list(life.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1301), SimpleNamespace(getExpiryTimeInMs=lambda: 1300)))
    assert timers == {2250} and [list(p[0]) for p in held["shown"]] == [[2]]
    assert call([(1, "own-kill", 1900), (1, "self-death", 1900), (2, "own-kill", 1900)], 1500) == ["kept", "kept", "repeat"]
    list(life.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 9000), SimpleNamespace(getExpiryTimeInMs=lambda: 2900)))
    assert not timers and held == {"shown": []}
