"""Delimited files and Parquet."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import decimal_comma, named, null_tokens
from ..operators.sizing import attach, store


def read_wave(
    spark: SparkSession, path: str, schema: StructType, na: Sequence[str] = ("NA",), sep: str = ","
) -> DataFrame:
    """A survey wave or poll file with a header row; types are given, never inferred.

    Spreadsheet tabs are landed as csv first.
    """
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", "UTF-8")
    if len(na) == 1:
        return reader.option("nullValue", na[0]).csv(path)
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields])
    raw = null_tokens(
        spark.read.schema(texts).option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path), na
    )
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their number (from 0) and file; empty lines are counted and left out.

    Large files are read in splits. Each split numbers its own lines; how many lines the splits before it hold comes from a table
    with a row for every split. The lines are written once to the shared folder, so their numbers stay as they are.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.regexp_replace("value", "\r$", "").alias("text"),
        F.monotonically_increasing_id().alias("_place"),
    )
    lines = store(lines)
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "_start").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).select("file", "_start", "_offset")
    numbered = attach(lines, splits, ["file", "_start"])
    return numbered.select("file", (F.col("_place") + F.col("_offset")).alias("line"), "text").filter(F.length("text") > 0)


def _fields(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` STRING" for n in names)


def read_statistics(
    spark: SparkSession,
    path: str,
    names: Sequence[str],
    skip: int = 0,
    sep: str = ";",
    na: Sequence[str] = ("",),
    numeric: Sequence[str] = (),
) -> DataFrame:
    """A published table: preamble lines, no usable header, decimal commas, NA marks.

    Columns get the given names; the ``numeric`` ones become double. The line
    number stays as ``line``, because these tables are labelled by position, with its ``file``: numbers start anew in each.
    """
    cells = (
        read_lines(spark, path)
        .filter(F.col("line") >= skip)
        .select("file", "line", F.from_csv("text", _fields(names), {"sep": sep}).alias("_row"))
        .select("file", "line", "_row.*")
    )
    cells = null_tokens(cells, na)
    return cells.withColumns({c: decimal_comma(named(c)) for c in numeric})


def read_two_row_header(
    spark: SparkSession,
    path: str,
    header_line: int,
    class_line: int,
    first_row: int,
    sep: str = ";",
    na: Sequence[str] = ("/", ""),
    id_columns: int = 1,
) -> DataFrame:
    """A table whose column names are spread over two lines, joined as ``upper.lower``.

    Only the header lines reach the driver, two of each file. Files with different heads cannot be one table and raise.
    Quoted separators in the head belong to the name.
    """
    rows = read_lines(spark, path).filter(F.col("line").isin(header_line, class_line)).collect()
    heads = {}
    for row in rows:
        heads.setdefault(row["file"], {})[row["line"]] = next(csv.reader([row["text"]], delimiter=sep))
    kinds = {tuple(map(tuple, (head[header_line], head[class_line]))) for head in heads.values()}
    if len(kinds) != 1:
        raise ValueError(f"{len(kinds)} different heads in the files of {path}")
    upper, lower = kinds.pop()
    names, group = [], ""
    for i, cell in enumerate(upper):
        group = cell.strip() or group
        below = lower[i].strip() if i < len(lower) else ""
        names.append(group if i < id_columns or not below else f"{group}.{below}")
    return read_statistics(spark, path, names, first_row, sep, na)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write Parquet and hand back the stored table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_csv(df: DataFrame, path: str) -> DataFrame:
    """Write csv with a header and hand back the stored table.

    Text is quoted where needed, so embedded commas survive.
    """
    df.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)
