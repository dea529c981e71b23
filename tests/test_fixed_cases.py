"""The parser and the identity rules on fixed cases."""

from fixed_events import EVENTS, PAIRS, SQUEEZED
from pyspark.sql import functions as F

from clipwright.functions import events, identity, text


def test_fixed_events(spark):
    cases = [(c, False) for c in EVENTS] + [(c, True) for c in SQUEEZED]
    assert len(EVENTS) == 18 and len(SQUEEZED) == 27
    df = spark.createDataFrame([(i, *c[:3], squeezed) for i, (c, squeezed) in enumerate(cases)], "i int, language string, target string, text string, squeezed boolean")
    given = df.withColumn("text", F.when(F.col("squeezed"), text.normalize_text(F.col("text"))).otherwise(F.col("text")))
    got = {r["i"]: [(e["target"], e["method"], e["action"], e["subject"], e["key"], e["weapon"]) for e in r["e"]] for r in given.select("i", events.text_events(F.col("text"), F.col("target"), F.col("language")).alias("e")).collect()}
    for i, (c, _) in enumerate(cases):
        assert got[i] == c[3], c


def test_fixed_pairs(spark):
    assert len(PAIRS) == 12
    rows = [(i, *a, *b) for i, (a, b, *_) in enumerate(PAIRS)]
    df = spark.createDataFrame(rows, "i int, ta string, aa string, sa string, ka string, tb string, ab string, sb string, kb string")

    def name(k):
        return F.get(F.split(k, ":", 3), F.lit(2))

    a, b = name("ka"), name("kb")
    alike = (F.col("ta") == F.col("tb")) & (F.col("aa") == F.col("ab"))
    same = alike & ((F.col("ka") == F.col("kb")) | identity.stable_subject(a, b))
    language = F.lit("zh-Hans")
    follow = [identity.followup_subject(F.col(f"t{x}"), name(f"k{x}"), F.col(f"s{x}"), language) for x in "ab"]
    got = {r["i"]: tuple(r)[1:] for r in df.select("i", same, same | (alike & identity.noisy_subject(a, b, F.col("ta"))), identity.noisy_subject(*follow, F.col("ta"))).collect()}
    for i, (x, y, *want) in enumerate(PAIRS):
        assert got[i] == tuple(want), (x, y)
        if x[:2] == y[:2]:  # the plain form of the rules, which the folds ask
            m, n = (e[3].split(":", 2)[2] for e in (x, y))
            assert (x[3] == y[3] or identity.stable_names(m, n)) == want[0]
            assert (want[0] or identity.noisy_names(m, n, x[0])) == want[1]
