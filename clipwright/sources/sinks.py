"""Reports as files: CSV with fixed columns, JSON documents, concat lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reports import CANDIDATE_COLUMNS, RECORD_COLUMNS


def csv_lines(df: DataFrame, columns: list[str]) -> Column:
    """A row as one CSV line: quoted where it holds a comma, a quote or a line end."""
    cells = []
    for c in columns:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        cells.append(F.when(F.regexp_like(v, F.lit("[,\"\r\n]")), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v))
    return F.concat_ws(",", *cells)


def write_report(records: DataFrame, path: str, columns: list[str] = RECORD_COLUMNS, bom: bool = False) -> None:
    """Comma-separated part files with CRLF line ends, each with a header before its rows; cells are quoted only where they must be and kept as they are.

    ``bom`` puts a byte-order mark before each header, as spreadsheets want it.
    """
    header = ("\ufeff" if bom else "") + ",".join(columns)
    # the first row of a task
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    lines = records.select(csv_lines(records, columns).alias("line"), first.alias("first"))
    both = lines.select(F.explode(F.when(F.col("first"), F.array(F.lit(header), "line")).otherwise(F.array("line"))).alias("value"))
    both.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_candidates(candidates: DataFrame, path: str, bom: bool = False) -> None:
    write_report(candidates, path, CANDIDATE_COLUMNS, bom)


def as_json(df: DataFrame) -> DataFrame:
    """``value``: each row as a JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("overwrite").text(path)


def concat_lines(clips: DataFrame, by: str = "target", seq: str = "clip_seq", path: str = "output") -> DataFrame:
    """(by, seq, line): one ``file '…'`` line for each clip; a path with a line end is an error."""
    plain = F.replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), F.lit("'"), F.lit("'\\''"))
    line = F.when(F.regexp_like(path, F.lit("[\r\n]")), F.raise_error(F.lit("a clip path holds a line end")).cast("string")).otherwise(F.concat(F.lit("file '"), plain, F.lit("'")))
    return clips.select(by, F.col(seq).alias("seq"), line.alias("line"))


def write_concat_lists(clips: DataFrame, folder: str, by: str = "target", seq: str = "clip_seq", path: str = "output") -> None:
    """Text part files in a folder for each target; in the order of their names they hold its lines in order.

    Clips are dealt by ranges of (target, place), so a target with most of the
    clips is many files and no task or row holds a whole list.
    """
    lines = concat_lines(clips, by, seq, path).repartitionByRange(by, "seq").sortWithinPartitions(by, "seq")
    lines.select(by, "line").write.mode("overwrite").partitionBy(by).text(folder)
