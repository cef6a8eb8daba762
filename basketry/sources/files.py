"""Loading the canonical tables from CSV or Parquet files."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, LongType, StringType, TimestampNTZType

from basketry.functions.coerce import (
    TIME_FORMATS, missing_to_null, to_id, to_number, to_utc_timestamp, to_whole_number,
)
from basketry.operators.grain import ORDER
from basketry.sources.schemas import SCHEMAS, IdType


def _parsed(text: Column, kind: DataType, time_formats: Iterable[str]) -> Column:
    """Text as a value of the given type; null where it does not parse."""
    if isinstance(kind, IdType):
        return to_id(text)
    if isinstance(kind, StringType):
        return text
    if isinstance(kind, TimestampNTZType):
        return to_utc_timestamp(text, time_formats)
    if isinstance(kind, LongType):
        return to_whole_number(text)
    return to_number(text, kind.simpleString())


def typed(
    df: DataFrame, table: str, missing_markers: bool, time_formats: Iterable[str] = TIME_FORMATS
) -> list[Column]:
    """All columns of a frame, those the table knows in the table's type."""
    known = {field.name: field.dataType for field in SCHEMAS[table]}
    columns = []
    for field in df.schema:
        kind = known.get(field.name, field.dataType)
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType):
            value = missing_to_null(value) if missing_markers else value
            value = _parsed(value, kind, time_formats)
        elif isinstance(kind, IdType):
            value = to_id(value.cast("string"))
        elif kind != field.dataType:
            value = value.try_cast(kind.simpleString())
        columns.append(value.alias(field.name))
    return columns


def _placed(raw: DataFrame, columns: list[Column]) -> DataFrame:
    """Columns and the position of a row in its files; the same on every recomputation.

    Files are ranked by path; within one, splits come by their offset and rows of a
    split as they stand. Rank, offset and row make one number of fixed width, so the
    path does not travel with the rows and first rows are picked by hashing. The ranks
    are a small frame of their own; Spark decides by its size how to join it.
    """
    # Local paths are written with one or three slashes, depending on who names them.
    files = sorted(re.sub("^file:/+", "file:/", path) for path in raw.inputFiles())
    ranks = raw.sparkSession.createDataFrame(
        pa.table({"ranked_file": pa.array(files, pa.string()), "file_rank": pa.array(range(len(files)), pa.int64())})
    )
    within = F.expr("monotonically_increasing_id() & 8589934591")  # without the partition's number
    rows = raw.select(
        F.struct(*columns).alias("columns"),
        F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        within.alias("row"),
    ).join(ranks, F.col("file") == F.col("ranked_file"), "left")
    wide = "decimal(38,0)"
    rank = F.coalesce("file_rank", F.lit(0)).cast(wide) * F.lit(str(1 << 75)).cast(wide)
    place = rank + F.col("block").cast(wide) * F.lit(str(1 << 33)).cast(wide) + F.col("row").cast(wide)
    return rows.select("columns.*", place.cast(wide).alias(ORDER))


def _check_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00", "GMT"):
        raise ValueError(
            f"times are read as UTC but the session is in {zone}: "
            "call basketry.apply_settings(spark) first"
        )


def read_csv(
    spark: SparkSession,
    table: str,
    path: str,
    multi_line: bool = False,
    time_formats: Iterable[str] = TIME_FORMATS,
    order: str | None = None,
) -> DataFrame:
    """Read CSV files with a header as one of the canonical tables.

    Columns are matched by name, in any order; columns the table does not know
    stay text and missing ones are left out (queries that need them say so).
    Values that do not parse become null (see :func:`unparsed`). Times are read in ISO
    form or else in one of ``time_formats``. ``order`` names the column that orders rows;
    by default their position in the files does. ``multi_line`` allows line breaks in
    quoted text, at the price of files that cannot be split.
    """
    _check_utc(spark)
    raw = _raw_csv(spark, path, multi_line)
    columns = typed(raw, table, missing_markers=True, time_formats=time_formats)
    return _placed(raw, columns) if order is None else raw.select(*columns, F.col(order).alias(ORDER))


def _raw_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    # Files whose header differs from the first one's are refused, not misread.
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )


def unparsed(
    spark: SparkSession,
    table: str,
    path: str,
    multi_line: bool = False,
    time_formats: Iterable[str] = TIME_FORMATS,
) -> DataFrame:
    """(column, texts): how many texts of each typed column :func:`read_csv` makes null.

    Empty texts and markers of missing values do not count.
    """
    _check_utc(spark)
    raw = _raw_csv(spark, path, multi_line)
    values = dict(zip(raw.columns, typed(raw, table, missing_markers=True, time_formats=time_formats)))
    lost = [
        F.count_if(missing_to_null(F.col(f"`{name}`")).isNotNull() & value.isNull()).alias(name)
        for name, value in values.items()
    ]
    counts = raw.agg(*lost)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("texts")) for c in raw.columns]
    return counts.select(F.inline(F.array(*pairs)))


def rejects(
    spark: SparkSession,
    table: str,
    path: str,
    multi_line: bool = False,
    time_formats: Iterable[str] = TIME_FORMATS,
) -> DataFrame:
    """(row_order, column, text): every text that :func:`read_csv` makes null, as it stands in the file.

    ``row_order`` is the row's place in the files, the one :func:`read_csv` gives it, so the
    loaded table and its rejects together hold all texts but markers of missing values.
    """
    _check_utc(spark)
    raw = _raw_csv(spark, path, multi_line)
    values = dict(zip(raw.columns, typed(raw, table, missing_markers=True, time_formats=time_formats)))
    lost = [
        F.when(
            missing_to_null(F.col(f"`{name}`")).isNotNull() & value.isNull(),
            F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").alias("text")),
        )
        for name, value in values.items()
    ]
    placed = _placed(raw, [F.filter(F.array(*lost), lambda x: x.isNotNull()).alias("lost")])
    return placed.select(ORDER, F.inline("lost"))


def read_parquet(spark: SparkSession, table: str, path: str, order: str | None = None) -> DataFrame:
    """Read Parquet files as one of the canonical tables.

    Columns are matched by name and brought to the table's types, text included;
    others are kept as they are. ``order`` names the column that orders rows; by
    default their position in the files does.
    """
    _check_utc(spark)
    raw = spark.read.parquet(path)
    columns = typed(raw, table, missing_markers=False)
    return _placed(raw, columns) if order is None else raw.select(*columns, F.col(order).alias(ORDER))
