"""Delimited pedigree tables: all columns are text, rows keep their number in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.tokens import missing_as_null, reference_flag, require, strip, without_reader_nulls

DELIMITERS = ("\t", ",", ";", "|")


class SourceError(ValueError):
    """A table that can't be read."""


def first_line(spark: SparkSession, path: str) -> str:
    """The first line that isn't blank; a plain or gzipped file on any file system."""
    for r in spark.read.text(path).where(F.length(strip("value")) > 0).take(1):
        return r["value"].rstrip("\r").removeprefix("﻿")
    raise SourceError(f"{path} is empty")


def sniff(line: str) -> str | None:
    """The most frequent delimiter; None for white space, where nothing else splits the line but blanks do."""
    counts = {d: line.count(d) for d in DELIMITERS}
    best = max(DELIMITERS, key=counts.__getitem__)
    if counts[best]:
        return best
    return None if len(line.split()) >= 2 else "\t"


def header(spark: SparkSession, path: str, sep: str | None = None) -> list[str]:
    line = first_line(spark, path)
    sep = sep or sniff(line)
    return [c.strip().strip('"') for c in (line.split(sep) if sep else line.split())]


def number_rows(lines: DataFrame) -> DataFrame:
    """``row``: 0, 1, ... in file order, without one big window: a count per partition gives each partition's first number."""
    marked = lines.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = marked.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    starts = sizes.select("_p", "first", (F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    # One row for each partition of the file: the number of splits bounds what is broadcast.
    return marked.join(F.broadcast(starts), "_p").withColumn("row", F.col("start") + F.col("_i") - F.col("first")).drop("_p", "_i", "first", "start")


def read_table(spark: SparkSession, path: str, sep: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The columns as text with the reader's nulls, and ``row``; ``columns`` projects before anything is parsed."""
    line = first_line(spark, path)
    sep = sep or sniff(line)
    names = header(spark, path, sep)
    if len(names) == 1 and "," in names[0]:
        raise SourceError(f"{path} has the single column {names[0]!r}: is it comma-separated?")
    if len(set(names)) != len(names):
        raise SourceError(f"{path} names a column twice")
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    lines = lines.where(F.length(strip("value")) > 0)
    lines = number_rows(lines).where("row > 0").withColumn("row", F.col("row") - 1)  # the header is line 0
    if sep is None:
        parts = F.split(F.btrim("value"), r"\s+")
        ragged = lines.where(F.size(parts) != len(names)).select("row", F.size(parts).alias("k")).orderBy("row").first()
        if ragged:
            raise SourceError(f"row {ragged['row']} has {ragged['k']} fields, the header {len(names)}")
    else:
        parsed = F.from_csv("value", ", ".join(f"_{i} string" for i in range(len(names))), {"sep": sep, "mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\u0000"})
        parts = F.array(*(parsed[f"_{i}"] for i in range(len(names))))
    keep = [(i, n) for i, n in enumerate(names) if columns is None or n in columns]
    return lines.select("row", parts.alias("p")).select("row", *(without_reader_nulls(F.get("p", F.lit(i))).alias(n) for i, n in keep))


def read_aligned(ids: DataFrame, table: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """The named columns for each of ``ids`` (id); an id without a row gets nulls."""
    own = table.select(strip(id_column).alias("_key"), *columns).dropDuplicates(["_key"])
    return ids.join(own, F.col("id").cast("string") == F.col("_key"), "left").drop("_key")


def reference_mask(ids: DataFrame, table: DataFrame, id_column: str, column: str) -> DataFrame:
    flag, bad = reference_flag(column)
    require(table, bad, column, f"{column} is neither true nor false")
    return read_aligned(ids, table.withColumn("reference", flag), id_column, ["reference"]).withColumn("reference", F.coalesce("reference", F.lit(False)))


def trait_tokens(ids: DataFrame, table: DataFrame, id_column: str, columns: list[str], missing: tuple[str, ...] = ()) -> DataFrame:
    return read_aligned(ids, table.withColumns({c: missing_as_null(c, missing) for c in columns}), id_column, columns)
