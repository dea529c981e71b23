"""Planning, dedupe, schedules, lifecycle and reports against plain transcriptions of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clipwright.functions import identity, text
from clipwright.operators import cache, clips, dedupe, lifecycle, reports, schedule, telemetry
from clipwright.sources import files, sinks
from clipwright.streaming import jobs


def _random_detections(seed, n=300):
    rng = random.Random(seed)
    return [(rng.randrange(6), i, round(rng.uniform(0, 120), 3), rng.choice(["own-kill", "self-death"]), f"own-kill:{rng.choice(['knock', 'eliminate'])}:p{rng.randrange(12)}", rng.choice(["molotov", "AKM"])) for i in range(n)]


@pytest.fixture(scope="module")
def detections(spark):
    rows = _random_detections(1)
    df = spark.createDataFrame(rows, "source_idx int, det_idx int, event_sec double, target string, event_key string, event_weapon string")
    df = df.withColumn("path", F.concat(F.lit("s"), F.col("source_idx").cast("string"))).withColumn("name", F.col("path")).withColumn("duration_sec", F.lit(120.0)).withColumn("language", F.lit("en"))
    return rows, df.withColumn("method", F.lit("m")).withColumn("text", F.col("event_key")).withColumn("scores", F.lit("0.5"))


def test_merge_like_a_loop(detections):
    rows, df = detections
    plan = clips.Planning()
    made, skipped = clips.plan_clips(df, plan)
    got = {(r["source_idx"], r["clip_idx"]): (round(r["start_sec"], 6), round(r["end_sec"], 6), int(r["event_count"])) for r in made.collect()}
    want = {}
    for s in range(6):
        own = sorted((r for r in rows if r[0] == s and r[2] >= 2), key=lambda r: (r[2], r[1]))
        start = end = None
        n = k = 0
        for r in own:
            before = 10.0 if r[5] == "molotov" and ":eliminate:" in r[4] else 5.0
            a, b = max(r[2] - before, 0), min(r[2] + 1, 120.0)
            if b <= a:
                b = min(a + 0.1, 120.0)
            if n and a <= end + 1e-6:
                n, end = n + 1, max(end, b)
            else:
                k, n, start, end = k + 1, 1, a, b
            want[s, k] = (round(start, 6), round(end, 6), n)
    assert got == want
    assert skipped.count() == sum(r[2] < 2 for r in rows)


def test_cross_source_like_a_loop(detections):
    rows, df = detections
    df = df.withColumn("clip_before_sec", F.lit(5.0)).withColumn("clip_after_sec", F.lit(1.0))
    got = {r["det_idx"] for r in dedupe.with_duplicates(df).filter("duplicate").collect()}
    held, want = {}, set()
    for r in sorted(rows, key=lambda r: (-(min(r[2], 5.0) + min(120.0 - r[2], 1.0)), r[0], r[1])):
        own = held.setdefault((r[3], r[4]), [])
        if any(o != r[0] for o in own):
            want.add(r[1])
        else:
            own.append(r[0])
    assert got == want
    assert {r["det_idx"] for r in dedupe.ranked(df).filter("path <> winner").collect()} == want


def test_lifecycle_folds_in_time(spark):
    rows = [(1, "own-kill", 0, 0, "knock", "own-kill:knock:player1", "player1"), (1, "own-kill", 900, 0, "knock", "own-kill:knock:playerl", "playerl"), (1, "own-kill", 3000, 0, "eliminate", "own-kill:eliminate:player1", "player1"),
            (1, "own-kill", 9000, 0, "eliminate", "own-kill:eliminate:zz99", "zz99"), (2, "self-death", 10, 0, "knock", "self-death:knock:a", "a"), (2, "self-death", 99_000, 0, "eliminate", "self-death:eliminate:b", "b")]
    df = spark.createDataFrame(rows, "source_idx int, target string, ms bigint, ord int, action string, key string, name string")
    for c in ("subject", "weapon", "method", "event_text"):
        df = df.withColumn(c, F.lit(""))
    got = {(r["source_idx"], r["ms"]): r["decision"] for r in lifecycle.decided(df.withColumn("actor", F.col("name")).withColumn("assisted", F.col("ms") == 9000)).collect()}
    assert got == {(1, 0): "kept", (1, 900): "repeat", (1, 3000): lifecycle.FOLLOWUP, (1, 9000): lifecycle.ASSISTED, (2, 10): "kept", (2, 99_000): lifecycle.SELF_FOLLOWUP}


def test_schedule(spark):
    df = spark.createDataFrame([(1, 60.0, [10.0])], "source_idx int, duration_sec double, hints array<double>")
    scan = schedule.Scan(coarse_step=20.0, windows=[(31.0, 43.0)])
    full = schedule.times(F.col("duration_sec"), F.col("hints"), scan)
    assert df.select(full).first()[0] == sorted({0, 20000, 40000, 60000, 31000, 35000, 39000, 43000, 2000, 6000, 10000})
    assert 10500 in df.select(schedule.times(F.col("duration_sec"), F.col("hints"), scan, adaptive=True)).first()[0]
    with pytest.raises(ValueError):
        schedule.Scan(coarse_step=float("nan"))
    reads = spark.createDataFrame([(1, t) for t in (0, 400, 900, 1000, 2500)], "source_idx int, ms bigint")
    assert [r["ms"] for r in schedule.spaced(reads, 900).orderBy("ms").collect()] == [0, 900, 2500]


def test_sources(spark):
    names = ["a 2024.02.30 - 01.02.03.Death.DVR.mp4", "b 2024.01.02 - 01.02.03.Double kill.DVR_2.mp4", "c.多杀.DVR.mp4", "d.Death cam.DVR.mp4", "e.淘汰.DVR.mp4"]
    df = spark.createDataFrame([(n, n) for n in names], "name string, path string")
    got = {r["name"][0]: r for r in files.select_sources(df, "both", explicit=True).collect()}
    assert got["b"]["source_idx"] == 1 and got["b"]["force_full_scan"] and got["b"]["language"] == "en"
    assert got["c"]["language"] == "zh-Hans" and got["e"]["language"] == "zh-Hans" and got["d"]["language"] is None
    assert got["a"]["recorded_at"] is None
    with pytest.raises(Exception, match="Invalid recording timestamp"):
        df.select(files.recorded_at(F.col("name"), strict=True)).collect()


def test_hints_file(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes("\ufeffName,OcrEventSec,EventSec\r\n\"x,1\",4.25,1\r\n\"x,1\",,6\r\nbad,oops,3\r\n,1,1\r\nn,NaN,2\r\n".encode())
    rows = files.read_hints(spark, str(tmp_path / "h.csv")).collect()
    assert sorted((r["name"], r["hint_sec"]) for r in rows) == [("x,1", 4.25), ("x,1", 6.0)]


def test_media_listing_and_json(spark, tmp_path):
    for n in ("a.MP4", "b.mp4", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert {r["name"] for r in files.list_media(spark, str(tmp_path)).collect()} == {"a.MP4", "b.mp4"}
    (tmp_path / "f.jsonl").write_text('{"frame_id":1,"text":"a"}\n\n{"frame_id":1,"text":"b"}\n')
    assert [r["text"] for r in files.read_json_rows(spark, str(tmp_path / "f.jsonl"), "frame_id int, text string").collect()] == ["b"]


def test_reports(spark, detections, tmp_path):
    _, df = detections
    made, skipped = clips.plan_clips(df, clips.Planning())
    made = clips.with_sequence(made).withColumn("name", F.lit("n,1")).withColumn("ordinal", F.col("clip_idx"))
    rows = reports.included_records(made)
    assert rows.columns[-len(reports.RECORD_COLUMNS):] == list(reports.RECORD_COLUMNS)
    sinks.write_report(rows, str(tmp_path / "r"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert back.count() == rows.count() and back.first()["Name"] == "n,1"
    assert reports.candidate_records(rows, "r").columns == list(reports.CANDIDATE_COLUMNS)
    assert [r["clip_seq"] for r in made.orderBy("source_idx", "clip_idx").collect()] == list(range(1, made.count() + 1))
    assert reports.skipped_records(skipped.withColumn("clip_before_sec", F.lit(0.0)).withColumn("clip_after_sec", F.lit(0.0)).withColumn("event_count", F.lit("1"))).filter("BeforeSec <> ''").count() == 0


def test_cache(spark):
    src = cache.with_cache_key(spark.createDataFrame([(1, "c1", [1.0]), (2, "c2", [1.0])], "id int, content_sha string, hints array<double>"), {"a": 1}, "m")
    first = src.filter("id = 1").select("cache_key", F.lit("p").alias("payload"))
    good = cache.new_entries(first)
    assert {r["id"]: r["cache_status"] for r in cache.looked_up(src, good).collect()} == {1: "hit", 2: "miss"}
    assert cache.missed(src, good.withColumn("checksum", F.lit("x"))).count() == 2


def test_budget_keeps_newest(spark):
    df = spark.createDataFrame([(i, 10, i) for i in range(100)], "id int, size int, mtime int")
    assert {r["id"] for r in telemetry.within_size_budget(df, 55, spread=7).collect()} == {95, 96, 97, 98, 99}


def test_clip_windows_drain_whole(spark, tmp_path):
    """Two files out of time order: touching windows merge, and neither late rows nor open sessions are lost."""
    for n, rows in enumerate([[(1, 7200), (2, 90_000)], [(1, 0), (1, 3600), (2, 93_601)]]):
        spark.createDataFrame(rows, "source_idx int, at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("source_idx int, at int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = raw.select("source_idx", F.timestamp_seconds("at").alias("win_start"), F.timestamp_seconds(F.col("at") + 3600).alias("win_end"))
    got = jobs.drained(jobs.clip_windows(s), "complete").select("source_idx", "event_count", F.unix_seconds("start_at"), F.unix_seconds("end_at"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 0, 10_800), (2, 1, 90_000, 93_600), (2, 1, 93_601, 97_201)]


def test_hot_groups_stay_rows(spark, detections):
    """Neither the spacing of reads nor the winner of an event holds a source or a key as one array or window."""
    reads = spark.range(20_000).select(F.lit(1).alias("source_idx"), (F.col("id") * 100).alias("ms"))
    out = schedule.spaced(reads, 900)
    assert [r["ms"] for r in out.orderBy("ms").collect()] == list(range(0, 2_000_000, 900))
    df = detections[1].withColumn("clip_before_sec", F.lit(5.0)).withColumn("clip_after_sec", F.lit(1.0))
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (out, dedupe.ranked(df))]
    assert "collect_set" not in plans[0] and "Window" not in plans[1]


def test_settings_are_checked():
    for bad in ({"start": -1}, {"start": 5, "end": 5}, {"end": float("inf")}, {"windows": [(3, 3)]}, {"windows": [(-1, 3)]}, {"coarse_step": 0}, {"candidate_step": 0.0005}, {"lookback": float("nan")}):
        with pytest.raises(ValueError):
            schedule.Scan(**bad)
    for bad in ({"roi": (0, 0, 0, 1)}, {"assist_roi": (0.5, 0, 0.4, 1)}, {"brightness_gate_roi": (0, 0, 1, 1.1)}, {"brightness_gate_mode": "x"}, {"sampling_mode": ""}, {"assist_step": 0}, {"refine_before": -1},
                {"refine_max_seconds": float("nan")}, {"frame_cache": 0}, {"roi": (0, 0, float("nan"), 1)}):
        with pytest.raises(ValueError):
            schedule.Recognition(**bad)
    assert schedule.Recognition(refine_max_seconds=3.0).frame_cache == 1
    assert schedule.region("0, 0.5,1,0.75") == (0, 0.5, 1, 0.75) and schedule.window("31:43.5") == (31, 43.5)
    for parse, texts in ((schedule.region, ("0,0,1", "0,0,1,x", "1,0,0,1", "")), (schedule.window, ("3", "3:3", "-1:2", "a:b", "1:inf"))):
        for text in texts:
            with pytest.raises(ValueError):
                parse(text)


def test_valid_regions(spark):
    boxes = [[0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0, 1.0], [0.0, None, 1.0, 1.0], None, [0.0, 0.0, float("nan"), 1.0]]
    df = spark.createDataFrame([(b,) for b in boxes], "box array<double>")
    assert [r["ok"] for r in df.select(schedule.valid_region(F.col("box")).alias("ok")).collect()] == [True, False, False, False, False, False]


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"q', None), ("", "line\nend", "x")], "Name string, Text string, Note string")
    for bom in (False, True):
        path = str(tmp_path / f"r{bom}")
        sinks.write_report(df.coalesce(1), path, ["Name", "Text", "Note"], bom=bom)
        raw = b"".join(p.read_bytes() for p in sorted((tmp_path / f"r{bom}").glob("part*")))
        assert raw.decode() == ("\ufeff" if bom else "") + 'Name,Text,Note\r\n"a,b","q""q",\r\n,"line\nend",x\r\n'


def test_concat_lists_are_ordered_files(spark, tmp_path):
    rows = [("own" if i % 3 else "self", i, f"c:\\x\\it's {i}.mp4") for i in range(500)]
    df = spark.createDataFrame(rows, "target string, clip_seq long, output string").orderBy(F.rand(1)).repartition(4)
    sinks.write_concat_lists(df, str(tmp_path / "lists"))
    for target in ("own", "self"):
        files_ = sorted((tmp_path / "lists" / f"target={target}").glob("part*"))
        lines = [line for f in files_ for line in f.read_text().splitlines()]
        assert lines == ["file 'c:/x/it'\\''s " + f"{i}.mp4'" for t, i, _ in rows if t == target]
    with pytest.raises(Exception, match="line end"):
        sinks.concat_lines(spark.createDataFrame([("own", 1, "a\nb")], "target string, clip_seq long, output string")).collect()


def shuffled(plan):
    """The records that the shuffles of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_ranks_move_few_values(spark):
    rows = spark.range(0, 60_000, 1, 8).select((F.col("id") % 3).alias("g"), F.hash("id").alias("v"))
    out = telemetry.ranks(rows, "g", "v", lambda n: {"lo": F.floor((n - 1) / 2) + 1, "hi": F.floor(n / 2) + 1})
    assert len(out.collect()) == 3
    assert shuffled(out._jdf.queryExecution().executedPlan()) < 6_000


@pytest.mark.parametrize("parts", [3, 200])
def test_ranks_like_sorting(spark, parts):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.choice([1.0, 1.0, 1.0, rng.uniform(0, 5), None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["_of"]: (r["lo"], r["top"]) for r in telemetry.ranks(df, "g", "v", lambda n: {"lo": F.floor((n - 1) / 2) + 1, "top": n}, parts).collect()}
    for g in ("a", "b", None):
        own = sorted(v for x, v in rows if x == g and v is not None)
        assert got[g] == (own[(len(own) - 1) // 2], own[-1])


def test_size_budget_like_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(1, 50), rng.choice([None, 7, rng.randrange(1000), i])) for i in range(400)]
    rows = [(i, s, m if m is None else m * 1000 + i) for i, s, m in rows]  # distinct times
    df = spark.createDataFrame(rows, "path long, size long, mtime long")
    left, want = 3000, set()
    for i, s, m in sorted((r for r in rows if r[2] is not None), key=lambda r: -r[2]):
        left -= s
        if left < 0:
            break
        want.add(i)
    assert {r["path"] for r in telemetry.within_size_budget(df, 3000, spread=10).collect()} == want


def test_report_numbers_are_exact(spark):
    values = [0.0025, 1.0005, 2.5, 0.1235, -0.0005, 1e13 + 0.5, 12345.6785, 0.0, -1.0004999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["t"] for r in df.select(reports.seconds_text(F.col("v")).alias("t")).collect()] == [f"{v:.3f}" for v in values]


def test_language_votes_like_a_loop(spark):
    """Scores by looking for every term, one after the other."""
    rng = random.Random(5)
    terms = sorted({t for p in files.PROFILES for k in ("own", "kill", "end") for t in p[k]})
    names = [f"REC {i}.{rng.choice(terms)}.DVR{rng.choice(['', '_1'])}.mp4" for i in range(200)] + ["x.淘汰画面.mp4", "plain.mp4", "死亡 Knockout.mp4", "Multi kill.DVR.mp4"]
    got = {r["name"]: r["language"] for r in files.infer_languages(spark.createDataFrame([(n,) for n in names], "name string"), "both").collect()}

    def hits(name, p, target):
        return max([len(t) for k in files.TARGETS[target] for t in p[k] if t.lower() in name.lower()], default=0)

    def replay(name, p):
        return bool(re.search(p["replay"], name, re.I))

    fit, votes = {}, {}
    for n in names:
        scores = [(hits(n, p, "both"), -i) for i, p in enumerate(files.PROFILES) if not replay(n, p) and any(re.search(rf"\.{t}\.DVR(_\d+)?\.mp4$", n, re.I) for k in ("own", "kill", "end") for t in p[k])]
        best = max(scores, default=(0, 0))[0]
        fit[n] = [-i for s, i in scores if s == best]
        if len(fit[n]) == 1:
            votes.setdefault(fit[n][0], []).append(best)
    order = sorted(votes, key=lambda i: (-len(votes[i]), -sum(votes[i]), i))
    for n in names:
        if fit[n]:
            want = next((i for i in order if i in fit[n]), fit[n][0]) if len(fit[n]) > 1 else fit[n][0]
        else:
            any_ = [(-hits(n, p, "both"), i) for i, p in enumerate(files.PROFILES) if hits(n, p, "both") and not any(replay(n, q) for q in files.PROFILES)]
            want = min(any_)[1] if any_ else None
        assert got[n] == (files.PROFILES[want]["language"] if want is not None else None), n


def test_lifecycle_like_loops(spark, monkeypatch):
    """Same players, assists, follow-ups and decisions against plain loops over noisy names."""
    rng = random.Random(6)
    bases = ["[ABC]Hunter77", "Sniper_Wolf", "noob12345", "李小龙玩家", "xXshadowXx"]

    def noisy(name):
        chars = list(name)
        if rng.random() < 0.6:
            chars[rng.randrange(len(chars))] = rng.choice("aZ9_")
        return "".join(chars[: rng.choice([len(chars), len(chars), len(chars) - 2, 6])])

    rows, seen = [], set()
    while len(rows) < 160:
        name, action, target = noisy(rng.choice(bases)), rng.choice(["knock", "eliminate"]), rng.choice(["own-kill", "own-kill", "self-death"])
        ms = rng.randrange(0, 60_000, 100)
        if (target, ms) not in seen:
            seen.add((target, ms))
            rows.append((1 + len(rows) % 2, target, ms, 0, action, name, f"{target}:{action}:{name}", name, name, "en", "", "", "", False))
    cols = "source_idx int, target string, ms long, ord int, action string, subject string, key string, name string, actor string, language string, weapon string, method string, event_text string, assisted boolean"
    df = spark.createDataFrame(rows, cols)
    got = {(r["source_idx"], r["target"], r["action"], r["a"], r["b"]): r["how"] for r in lifecycle.same_pairs(df).collect()}
    want = {}
    for x in rows:
        for y in rows:
            if x[:2] == y[:2] and x[4] == y[4] and x[6] < y[6]:
                at = (*x[:2], x[4], x[6], y[6])
                if identity.stable_names(x[7], y[7]):
                    want[at] = "stable"
                elif abs(x[2] - y[2]) <= 5000 and identity.noisy_names(x[7], y[7], x[1]):
                    want.setdefault(at, "noisy")
    assert got == want and set(want.values()) == {"stable", "noisy"}

    follow = {(r["source_idx"], r["target"], r["ms"]): r["method"] for r in lifecycle.followups(df).collect()}
    want = {}
    for x in rows:
        knocks = [y for y in rows if y[:2] == x[:2] and y[4] == "knock" and y[2] <= x[2]]
        if x[4] == "eliminate" and x[1] == "self-death" and knocks:
            want[x[:3]] = lifecycle.SELF_FOLLOWUP
        elif x[4] == "eliminate" and any(x[2] - y[2] <= 5000 and identity.noisy_names(x[8], y[8], x[1]) for y in knocks):
            want[x[:3]] = lifecycle.FOLLOWUP
    assert follow == want and len(set(want.values())) == 2

    frames = [(r[0], r[2] + rng.choice([0, 500, 1000, 700, 1500]), "你助攻淘汰了" + r[7], "zh-Hans", r[4], rng.choice([r[6], "own-kill:x:other"]), noisy(r[7])) for r in rows if rng.random() < 0.6]
    shown = spark.createDataFrame(frames, "source_idx int, ms long, text string, language string, action string, key string, name string")
    is_assist = {r["text"]: r["a"] for r in shown.select("text", text.is_assist_only(F.col("text"), F.col("language")).alias("a")).collect()}
    got = {(r["source_idx"], r["target"], r["ms"]) for r in lifecycle.with_assists(df.drop("assisted"), shown).filter("assisted").collect()}
    want = {x[:3] for x in rows if x[1] == "own-kill" and any(f[0] == x[0] and f[4] == x[4] and is_assist[f[2]] and 0 <= f[1] - x[2] <= 1200 and (f[1] - x[2]) % 500 == 0 and (f[5] == x[6] or identity.stable_names(f[6], x[7])) for f in frames)}
    assert got == want and 5 < len(want) < len(rows)

    decided = {(r["source_idx"], r["target"], r["ms"]): r["decision"] for r in lifecycle.decided(df).collect()}
    monkeypatch.setattr(lifecycle, "TOGETHER", 0)  # the same by groups of names
    assert {(r["source_idx"], r["target"], r["ms"]): r["decision"] for r in lifecycle.decided(df).collect()} == decided
    monkeypatch.setattr(lifecycle, "FEW", 3)  # and by links from what alike names cannot lack
    assert {(r["source_idx"], r["target"], r["ms"]): r["decision"] for r in lifecycle.decided(df).collect()} == decided
    want, held = {}, {}
    for x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        own = held.setdefault(x[:2], [])
        if any(y[4] == x[4] and (y[6] == x[6] or identity.stable_names(x[7], y[7]) or (abs(x[2] - y[2]) <= 5000 and identity.noisy_names(x[7], y[7], x[1]))) for y in own):
            want[x[:3]] = "repeat"
            continue
        knocks = [y for y in own if y[4] == "knock"]
        want[x[:3]] = "kept"
        if x[4] == "eliminate" and x[1] == "self-death" and knocks:
            want[x[:3]] = lifecycle.SELF_FOLLOWUP
        elif x[4] == "eliminate" and any((x[1] != "own-kill" or x[2] - y[2] <= 5000) and identity.noisy_names(x[8], y[8], x[1]) for y in knocks):
            want[x[:3]] = lifecycle.FOLLOWUP
        own.append(x)
    assert decided == want and len(set(want.values())) >= 3


def test_a_hot_recording_is_folded_in_parts(spark, monkeypatch):
    """One source with all events of 300 players far from each other: each is folded alone, and the decisions are those of one fold."""
    rng = random.Random(8)
    names = [f"{rng.getrandbits(80):020x}"[:14].translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(300)]
    rows = [(1, rng.choice(["own-kill", "self-death"]), i * 40, 0, rng.choice(["knock", "eliminate"]), n, f"k:x:{n}", n, n, "", "", "", False) for i, n in enumerate(rng.choice(names) for _ in range(2500))]
    df = spark.createDataFrame(rows, "source_idx int, target string, ms long, ord int, action string, subject string, key string, name string, actor string, weapon string, method string, event_text string, assisted boolean")
    monkeypatch.setattr(lifecycle, "TOGETHER", 0)
    parts = {(r["target"], r["name"]): r["part"] for r in lifecycle.name_groups(df).collect()}
    sizes = {}
    for r in rows:
        part = (r[1], parts.get((r[1], r[7]), r[7]))
        sizes[part] = sizes.get(part, 0) + 1
    assert max(sizes.values()) < len(rows) / 20
    got = {(r["target"], r["ms"]): r["decision"] for r in lifecycle.decided(df).collect()}
    want, held = {}, {}
    for x in rows:
        seen = held.setdefault(x[1], lifecycle._Seen(x[1]))
        if seen.repeats(x[4], x[6], x[7], x[2]):
            want[x[1], x[2]] = "repeat"
            continue
        want[x[1], x[2]] = seen.follows(x[4], x[8], x[2]) or "kept"
        seen.add(x[4], x[6], x[7], x[8], x[2])
    assert got == want and len(set(want.values())) == 4


def test_json_rows_of_several_files_and_parts(spark, tmp_path):
    """The last line of a key wins: files by path, a large file in many parts, blank lines and lines without a key passed over."""
    import json

    rng = random.Random(9)
    want, folder = {}, tmp_path / "rows"
    folder.mkdir()
    for name in ("b.jsonl", "a.jsonl", "c.jsonl"):
        lines = [(rng.choice([None, *range(300)]), f"{name} {i} " + "x" * rng.randrange(80)) for i in range(4000 if name == "b.jsonl" else 60)]
        (folder / name).write_text("".join(json.dumps({"frame_id": k, "text": t}) + "\n" + rng.choice(["", "", "  \n"]) for k, t in lines))
        want[name] = {k: t for k, t in lines if k is not None}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.read_json_rows(spark, str(folder), "frame_id int, text string")
        assert rows._jdf.queryExecution().toRdd().getNumPartitions() > 3 or spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        got = {r["frame_id"]: r["text"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want["a.jsonl"] | want["b.jsonl"] | want["c.jsonl"]


def test_throughput_medians_are_exact(spark):
    rng = random.Random(10)
    rows = [(rng.choice(["a", "b"]), rng.uniform(1, 2), rng.uniform(1, 9)) for _ in range(301)] + [("one", 2.0, 3.0), (None, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, wall_s double, baseline_s double").selectExpr("*", "1 as verify_s", "2 as task_s", "3 as clips", "4.0 as media_s")
    got = {r["g"]: r["median_speedup"] for r in telemetry.throughput(df, "g").collect()}
    for g in ("a", "b", "one", None):
        own = sorted(b / w for x, w, b in rows if x == g)
        assert got[g] == pytest.approx((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2, rel=1e-12)
