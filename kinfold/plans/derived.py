"""A pedigree derived from the customer table, the same in Spark and in SQL, and a dirty variant of it as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.families import Families
from kinfold.operators.graph import closure, structural_depth
from kinfold.session import ship, stored


def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sex, mother, father, acctbal, segment: ids below 48 are founders, parents have smaller ids."""
    ship(spark)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment")
    i, k = F.col("c_custkey"), F.floor(F.col("c_custkey") / 4)
    half = F.floor(k / 2) + 1
    founder = i < 48
    return c.select(
        i.cast("long").alias("id"), F.when(i % 2 == 0, "F").otherwise("M").alias("sex"),
        F.when(~founder, 2 * ((37 * k + 11) % half)).cast("long").alias("mother"), F.when(~founder, 2 * ((53 * k + 5) % half) + 1).cast("long").alias("father"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"),
    )


def partial(ped: DataFrame) -> DataFrame:
    """With half-founders, and with unknown sexes of persons who are nobody's parent or are."""
    i = F.col("id")
    return ped.withColumn("mother", F.when(i % 17 != 3, F.col("mother"))).withColumn("father", F.when(i % 19 != 5, F.col("father"))).withColumn("sex", F.when(i % 23 != 7, F.col("sex")))


class Derived:
    """The pedigree with what several queries need, each made once; ``whole`` is False for the one with gaps and twins."""

    def __init__(self, spark: SparkSession, sf_dir: str, whole: bool = True) -> None:
        ped = pedigree(spark, sf_dir)
        self.ped = stored(ped if whole else partial(ped), "pedigree")
        self.whole = whole
        self._made: dict[str, DataFrame] = {}
        self._families: Families | None = None

    @property
    def twins(self) -> DataFrame | None:
        """Linked pairs: every tenth family's first and third child."""
        if self.whole:
            return None
        first = self.ped.where("id >= 48 and id % 40 = 0").select(F.col("id").alias("id1"), (F.col("id") + 2).alias("id2"))
        return first.join(self.ped.select(F.col("id").alias("id2")), "id2", "left_semi").select("id1", "id2")

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = stored(make(), name)
        return self._made[name]

    @property
    def depth(self) -> DataFrame:
        return self._once("depth", lambda: structural_depth(self.ped))

    @property
    def paths(self) -> DataFrame:
        return self._once("closure", lambda: closure(self.ped))

    @property
    def families(self) -> Families:
        if self._families is None:
            self._families = Families(self.ped, self.depth)
        return self._families

    @property
    def inbred(self) -> DataFrame:
        return self.families.inbred

    @property
    def dated(self) -> DataFrame:
        """With birth years 25 years apart by depth."""
        return self._once("dated", lambda: self.ped.join(self.depth, "id").withColumn("birth_year", (1900 + 25 * F.col("depth") + F.col("id") % 20).cast("int")))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns with every 97th row twice, some parents absent, some sexes swapped, missing or odd years, some twins."""
    p = pedigree(spark, sf_dir)
    i = F.col("id")
    text = p.select(
        i, F.when(i % 31 == 5, "").when(i % 43 == 7, F.when(F.col("sex") == "F", "M").otherwise("F")).otherwise(F.col("sex")).alias("sex"),
        F.when(i % 53 == 9, F.concat(F.lit("9"), (1000000 + i).cast("string"))).otherwise(F.coalesce(F.col("mother").cast("string"), F.lit("-1"))).alias("mother"),
        F.when(i % 59 == 11, "NA").otherwise(F.coalesce(F.col("father").cast("string"), F.lit("."))).alias("father"),
        F.when(i % 61 == 3, "2500").when(i % 67 == 4, "").otherwise((1900 + F.floor(i / 40)).cast("string")).alias("birth_year"),
        F.when((i >= 48) & (i % 100 < 2), F.concat(F.lit("s"), F.floor(i / 100).cast("string"))).alias("twin_set"), F.when((i >= 48) & (i % 100 < 2), "MZ").alias("zygosity"),
    )
    rows = text.withColumn("row", 2 * i).unionByName(text.where("id % 97 = 2").withColumn("row", 2 * i + 1))
    return rows.withColumn("id", i.cast("string"))
