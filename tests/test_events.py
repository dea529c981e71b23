"""Text functions and events; the cases are fixed values."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from clipwright.functions import diagnostics, events, identity, numbers, reading, text
from clipwright.functions.vocabulary import LANGUAGES

CASES = [
    ("zh-Hans", "own-kill", "你用M416淘汰了EnemyA", [("own-kill", "eliminate", "EnemyA", "own-kill:eliminate:enemya", "M416")]),
    ("zh-Hans", "own-kill", "你使用AKM击倒了A1你用AKM淘汰了B2", [("own-kill", "knock", "A1", "own-kill:knock:a1", "AKM"), ("own-kill", "eliminate", "B2", "own-kill:eliminate:b2", "AKM")]),
    ("zh-Hans", "own-kill", "你用M416淘汰了EnemyA助攻", []),
    ("zh-Hans", "own-kill", "你终于淘汰了EnemyA", []),
    ("zh-Hans", "self-death", "击倒了你", [("self-death", "knock", "", "self-death:knock:unknown", "")]),
    ("zh-Hans", "self-death", "你在安全区外倒地了", [("self-death", "zone-downed", "zone", "self-death:zone", "")]),
    ("zh-Hant", "own-kill", "您以M416擊殺EnemyB", [("own-kill", "eliminate", "EnemyB", "own-kill:eliminate:enemyb", "M416")]),
    ("en", "own-kill", "YOU KNOCKED OUT Foe_1 with AKM", [("own-kill", "knock", "Foe_1", "own-kill:knock:foe_1", "AKM")]),
    ("en", "both", "Foe KILLED YOU with P90\nYOU KILLED Bar", [("self-death", "eliminate", "Foe", "self-death:eliminate:foe", "P90"), ("own-kill", "eliminate", "Bar", "own-kill:eliminate:bar", "")]),
    ("en", "both", "", []),
    ("en", "both", None, []),
]


def test_events(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, language string, target string, text string")
    got = {r["i"]: [(e["target"], e["action"], e["subject"], e["key"], e["weapon"]) for e in r["e"]] for r in df.select("i", events.text_events(F.col("text"), F.col("target"), F.col("language")).alias("e")).collect()}
    for i, c in enumerate(CASES):
        if c[1] == "both" and c[2] and "\n" in c[2]:
            assert got[i][0] == c[3][0]
        else:
            assert got[i] == c[3], c


@pytest.mark.parametrize("target,roi,expected", [("both", False, "paddle-own-kill-delayed-elim-skipped"), ("self-death", False, "paddle-not-target-text"), ("both", True, "paddle-not-assist-text")])
def test_classification(spark, target, roi, expected):
    df = spark.createDataFrame([("你终于淘汰了X1",)], "t string")
    assert df.select(events.classification(F.col("t"), F.lit(target), F.lit("zh-Hans"), F.lit(roi))).first()[0] == expected


def test_normalize_and_language(spark):
    df = spark.createDataFrame([(" a\u3000b\x1c \r\n\n c ",)], "t string")
    assert df.select(text.normalize_text(F.col("t"))).first()[0] == "abc"
    assert df.select(text.normalize_rows(F.col("t"))).first()[0] == "ab\nc"
    rows = spark.createDataFrame([("abc",), ("擊倒",), ("击倒",)], "t string").select(text.guess_language(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["en", "zh-Hant", "zh-Hans"]


PAIRS = [("player1", "player1"), ("player1", "playerl"), ("abcd", "xabcdx"), ("", "a"), ("[tag]name1", "x[TAG]NAME1z"), ("longname12", "longname99"), ("ab" * 120, "ba" * 120), ("名字一二三", "名字一二四")]


def test_identity_matches_plain_rules(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "i int, a string, b string")
    for target in ("own-kill", "self-death"):
        rows = df.select("i", identity.stable_subject(F.col("a"), F.col("b")).alias("s"), identity.noisy_subject(F.col("a"), F.col("b"), F.lit(target)).alias("n"), identity.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
        for r in rows:
            a, b = PAIRS[r["i"]]
            assert r["s"] == identity.stable_names(a, b)
            assert r["n"] == identity.noisy_names(a, b, target)
            assert r["r"] == SequenceMatcher(None, a, b).ratio()


def test_numbers(spark):
    df = spark.createDataFrame([(0.0025,), (1.0005,), (2.5,), (-0.001,)], "x double")
    rows = df.select(numbers.fixed3(F.col("x")), numbers.rounded_exactly(F.col("x")), numbers.fixed3_of_ms(numbers.ms_key(F.col("x")))).collect()
    assert [r[0] for r in rows] == ["0.003", "1.000", "2.500", "-0.001"]
    assert [r[1] for r in rows] == [0.003, 1.0, 2.5, -0.001]
    assert rows[3][2] == "-0.001"


def test_redaction(spark):
    df = spark.createDataFrame([(r"bad C:\a b\x.cpp(12): gone /opt/m/x.onnx",)], "t string")
    assert df.select(diagnostics.redact(F.col("t"))).first()[0] == "bad <local-path>(12): gone <local-path>"


def test_reading_order(spark):
    rows = [(1, 50, 0, 60, 20, "b", 0.5), (1, 0, 2, 40, 22, "a", 0.9), (1, 0, 30, 40, 50, "c", 0.1)]
    df = spark.createDataFrame(rows, "f int, x1 int, y1 int, x2 int, y2 int, text string, score double")
    r = reading.assembled(df, "f").first()
    assert r["text"] == "a b\nc" and r["scores"] == [0.9, 0.5, 0.1] and r["n_rows"] == 2


def test_a_text_is_parsed_once(spark, tmp_path):
    """Neither a filter that Spark infers nor a label's several conditions look for the kills again."""
    spark.createDataFrame([("YOU KNOCKED OUT A with W", "en"), ("", "en"), (None, None)], "text string, language string").write.parquet(str(tmp_path / "t"))
    frames, own = spark.read.parquet(str(tmp_path / "t")), LANGUAGES["en"].own
    conf = "spark.sql.maxPlanStringLength"
    spark.conf.set(conf, 10_000_000)
    try:
        parsed = events.exploded_events(frames, "both")
        label = frames.select(events.classification(F.col("text"), F.lit("both"), F.col("language"), F.lit(False)).alias("m"))
        for made in (parsed, label):
            assert made._jdf.queryExecution().optimizedPlan().toString().count(own) == 1
        assert [(r["ord"], r["subject"]) for r in parsed.collect()] == [(0, "A")]
        assert sorted(r["m"] for r in label.collect()) == ["paddle-not-target-text", "paddle-not-target-text", "paddle-own-kill-text"]
    finally:
        spark.conf.unset(conf)
