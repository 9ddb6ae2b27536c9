"""Sessions: the settings local runs and tests use, and the package's code for the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster, bring your own."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("kinfold").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's code to the executors, once per application, so that Python workers can import it.

    Batches for Python are made smaller than by default, unless the session sets them: long texts and the memory of two
    workers beside a heap are what an executor has to hold.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="kinfold-")
        target = os.path.join(folder, "kinfold.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, Path(here.name) / p.relative_to(here))
        spark.sparkContext.addPyFile(target)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only in local mode."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or os.environ.get("KINFOLD_SHARED_DIR")
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = os.path.join(tempfile.gettempdir(), f"kinfold-{os.getpid()}")
        os.environ["KINFOLD_SHARED_DIR"] = where
    return where.rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step of a loop as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    The table goes when the application ends, or with ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinfold_path = path
    return out


def counted(df: DataFrame, name: str = "step", **totals: Column) -> tuple[DataFrame, dict]:
    """``stored``, with aggregates of the rows that were written, from the same job; ``n`` is their number.

    They are taken in the stage that writes, whose tasks count once, however often one is tried.
    """
    seen = Observation()
    totals = {"n": F.count(F.lit(1)), **totals}
    out = stored(df.observe(seen, *(c.alias(k) for k, c in totals.items())), name)
    return out, seen.get


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``name``: 1, 2, ... in the order of ``order``, by ranges: each range is sorted by itself and begins where the one before ends."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    d = stored(d, "ranges")
    sizes = sorted((r["_p"], r["first"], r["n"]) for r in d.groupBy("_p").agg(F.min("_i").alias("first"), F.count("*").alias("n")).collect())  # a row per range
    starts, total = [], 0
    for p, first, n in sizes:
        starts.append((p, total - first + 1))
        total += n
    begin = F.broadcast(df.sparkSession.createDataFrame(starts, "_p int, _begin long"))
    return d.join(begin, "_p").withColumn(name, F.col("_begin") + F.col("_i")).drop("_p", "_i", "_begin")


def forget(df: DataFrame | None) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    path = getattr(df, "_kinfold_path", None)
    if path:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
