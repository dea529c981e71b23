"""Rows through Python as Arrow batches, so that ids stay the integers they are, nulls included."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[Mapping]], ddl: str) -> DataFrame:
    """``df`` through ``run``, which takes Arrow batches and gives out columns by name: lists, numpy arrays or Arrow arrays."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(given):
            yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in schema], schema=schema)

    return df.mapInArrow(batches, ddl)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()
