"""Tables that cut lineage: written to the folder every executor shares.

The folder is the session's ``spark.checkpoint.dir``.  Where that is unset
(tests on one machine) a fresh temporary folder is taken and recorded in the
session, so one session uses one folder.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Rows of a small table that one task writes at least: many steps write little, and each file and task costs more than some thousand rows.
EACH = 20_000
#: Rows and bytes that go to Python at once while a table is written: Spark's 10,000 rows of long texts fill the memory of an executor twice, outside its heap and in Python.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_KEY, found)
    return found


class Kept:
    """One written table: ``df`` reads it, ``drop()`` removes its files."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self._spark, self.path = spark, path
        self.df: DataFrame = spark.read.schema(schema).parquet(path)

    @cached_property
    def n(self) -> int:
        """The number of its rows."""
        return self.df.count()

    def drop(self) -> None:
        jvm = self._spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self._spark._jsc.hadoopConfiguration())
        fs.delete(where, True)


def in_few(df: DataFrame, rows: int, each: int = EACH) -> DataFrame:
    """``df`` of about so many rows in no more tasks than they are worth, six at least."""
    return df.coalesce(max(6, math.ceil(rows / each)))


def keep(df: DataFrame, codec: str = "zstd", rows: int | None = None) -> Kept:
    """Write ``df`` once and read it back without its lineage; if its ``rows`` are known to be few, in few files."""
    spark = df.sparkSession
    if rows is not None:
        df = in_few(df, rows)
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _BATCHES}
    for k, v in _BATCHES.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return Kept(spark, path, df.schema)
