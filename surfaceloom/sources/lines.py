"""Lines in and lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stripped(line: Column) -> Column:
    """A line without carriage returns at its end."""
    return F.rtrim(line, F.lit("\r"))


def records(df: DataFrame) -> DataFrame:
    """line without carriage returns at the end; empty lines go."""
    return df.withColumn("line", stripped(F.col("line"))).where(F.octet_length("line") > 0)


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """source, ord and line of text files, in the order of paths, files and lines; a last line needs no line feed.

    ord is (source, file, block, row) as a struct, as rows alone aren't in order where a file is read by many tasks.
    """
    if not paths:
        raise ValueError("no input: name one path at least")
    each = [
        spark.read.option("lineSep", "\n").text(p).select(F.lit(i).alias("source"), F.struct(F.lit(i), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord"), F.col("value").alias("line"))
        for i, p in enumerate(paths)
    ]
    out = each[0]
    for df in each[1:]:
        out = out.unionAll(df)
    return records(out)


def read_table(spark: SparkSession, path: str, line: str, ord_col: str) -> DataFrame:
    """ord and line of a Parquet table's columns; only these two are read."""
    return records(spark.read.parquet(path).select(F.col(ord_col).alias("ord"), F.col(line).alias("line")))


def union(*tables: DataFrame) -> DataFrame:
    """Tables of ord and line one after the other: source and ord tell rows apart."""
    parts = [t.select(F.struct(F.lit(i).alias("source"), F.col("ord")).alias("ord"), "line") for i, t in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def write_lines(df: DataFrame, path: str, ord_col: str = "ord", single_file: bool = False) -> None:
    """out as text files in order of arrival: range-partitioned, or one file."""
    ordered = df.repartition(1).sortWithinPartitions(ord_col) if single_file else df.orderBy(ord_col)
    ordered.select("out").write.option("lineSep", "\n").text(path)
