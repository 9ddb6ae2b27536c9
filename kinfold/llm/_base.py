"""What the operators of this subpackage share: reading, shared tables, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import counted, forget, shared_dir, stored

__all__ = ["counted", "crc_mod", "forget", "partitions", "read", "shared_dir", "sized", "stored", "texts"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; only Spark opens the path, so any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def sized(df: DataFrame, documents: int, each: int = 5_000, least: int = 8) -> DataFrame:
    """``df``, a table that follows from so many documents, in one partition for every ``each`` of them.

    A session may deal every shuffle to many partitions; a table of a few thousand rows needn't be as many files.  Where there
    are as many documents as partitions call for, this changes nothing.
    """
    return df.coalesce(max(least, -(-documents // each)))


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever else the table holds; rows without an id take no part."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull())


def crc_mod(column: str, n: int):
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
