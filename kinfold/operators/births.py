"""Multiple births: sets by gap sessions, checks of recorded sets, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.session import numbered


def birth_sets(rows: DataFrame, most_days: int) -> DataFrame:
    """id and set: full sibs born within ``most_days`` of the one before, where at least two are.

    Sets are numbered by mother, father and first date.
    """
    known = rows.where("mother is not null and father is not null and birth_date is not null")
    order = W.partitionBy("mother", "father").orderBy("birth_date", "id")
    gap = F.datediff("birth_date", F.lag("birth_date").over(order))
    marked = known.withColumn("new", F.when(gap <= most_days, 0).otherwise(1)).withColumn("session", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    sets = marked.groupBy("mother", "father", "session").agg(F.count("*").alias("size"), F.min("birth_date").alias("first")).where("size >= 2")
    sets = numbered(sets, "mother", "father", "first", name="set").withColumn("set", F.col("set").cast("int"))
    return marked.join(sets.select("mother", "father", "session", "set"), ["mother", "father", "session"]).select("id", "set")


def number_by_first_row(rows: DataFrame, key: str = "set", row: str = "row") -> DataFrame:
    """key and number: sets in the order of their first row."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("first"))
    return numbered(first, "first", name="number").select(key, F.col("number").cast("int").alias("number"))


def decade(ped: DataFrame) -> DataFrame:
    """set and decade of the least known birth year of its members; null if unknown."""
    return ped.where("set is not null").groupBy("set").agg((F.floor(F.min("birth_year") / 10) * 10).cast("int").alias("decade"))


def set_table(ped: DataFrame) -> DataFrame:
    """set, size, males, females, unknown, full_sibs (all members have the same two parents), decade."""
    kinds = F.countDistinct(F.struct("mother", "father"))
    known = F.count_if(F.col("mother").isNull() | F.col("father").isNull()) == 0
    return ped.where("set is not null").groupBy("set").agg(F.count("*").alias("size"), F.count_if(F.col("sex") == "M").alias("males"), F.count_if(F.col("sex") == "F").alias("females"), F.count_if(F.col("sex").isNull()).alias("unknown"), (known & (kinds == 1)).alias("full_sibs"), (F.floor(F.min("birth_year") / 10) * 10).cast("int").alias("decade"))


def births_by_size(ped: DataFrame) -> DataFrame:
    return set_table(ped).groupBy("size").agg(F.count("*").alias("n_sets"), F.avg(F.col("full_sibs").cast("double")).alias("full_sib_fraction"))


def sets_by_decade(ped: DataFrame) -> DataFrame:
    """Sets by decade: their number, members, and how many are larger than two; a set of unknown decade has a null one."""
    return set_table(ped).groupBy("decade").agg(F.count("*").alias("n_sets"), F.sum("size").alias("n_members"), F.count_if(F.col("size") > 2).alias("n_larger"))


def twin_pairs_by_sex(ped: DataFrame, by_decade: bool = False) -> DataFrame:
    """Twin pairs by sex mix, with Weinberg's estimate: dizygotic pairs are twice the mixed ones, the rest monozygotic."""
    two = set_table(ped).where("size = 2")
    keys = ["decade"] if by_decade else []
    got = two.groupBy(*keys).agg(F.count_if(F.col("males") == 2).alias("mm"), F.count_if(F.col("females") == 2).alias("ff"), F.count_if((F.col("males") == 1) & (F.col("females") == 1)).alias("mf"), F.count_if(F.col("unknown") > 0).alias("unknown"))
    known = F.col("mm") + F.col("ff") + F.col("mf")
    return got.select(*keys, "mm", "ff", "mf", "unknown", F.least(2 * F.col("mf"), known).alias("dizygotic"), (known - F.least(2 * F.col("mf"), known)).alias("monozygotic"))
