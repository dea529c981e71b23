"""Rounding in the JVM against Python's, which rounds the exact binary value."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from clipwright.functions import numbers


def both(spark, values, tmp_path):
    pd.DataFrame({"x": pd.array(values, dtype="Float64")}).to_parquet(tmp_path / "x.parquet")
    df = spark.read.parquet(str(tmp_path / "x.parquet")).select("x", numbers.fixed3(F.col("x")).alias("text"), numbers.rounded_exactly(F.col("x")).alias("value"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    return df.toPandas()


def test_fixed3_of_random_and_halfway_values(spark, tmp_path):
    """A million values: random bits, random decimals, and the doubles at and beside every middle of two thousandths."""
    rng = random.Random(3)
    middles = [(k + 0.5) / 1000 for k in range(120_000)] + [rng.randrange(10**12) + (rng.randrange(1000) + 0.5) / 1000 for _ in range(80_000)] + [k / 16 for k in range(20_000)] + [k + 0.0625 * j for k in (2**30, 2**40, 2**43, 2**48, 2**51) for j in range(64)]
    values = [v for m in middles for v in (m, math.nextafter(m, 0), math.nextafter(m, math.inf))]
    values += [rng.uniform(0, 10 ** rng.randrange(1, 15)) for _ in range(300_000)] + [math.ldexp(rng.random(), rng.randrange(-80, 63)) for _ in range(100_000)]
    values = [v if rng.random() < 0.8 else -v for v in values]
    assert len(values) > 1_000_000
    got = both(spark, values, tmp_path)
    assert got["text"].tolist() == [f"{v:.3f}" for v in values]
    assert [repr(v) for v in got["value"]] == [repr(round(v, 3)) for v in values]


def test_fixed3_of_odd_values(spark):
    values = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, -0.0004, 0.9995, 0.9996, -1.9999, 2.0**53, 2.0**62, 1e22, 5e-324, 999999999.9995]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", numbers.fixed3(F.col("x")).alias("t"), numbers.rounded_exactly(F.col("x")).alias("r")).collect()
    for i, t, r in rows:
        v = values[i]
        assert t == (None if v is None or v != v else f"{v:.3f}")
        assert r is None if v is None else repr(r) == repr(round(v, 3) if math.isfinite(v) else v)
