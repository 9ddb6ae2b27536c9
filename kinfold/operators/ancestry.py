"""What follows from the ancestor paths: contributions, inbreeding, kinship."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import stored


def founders(ped: DataFrame) -> DataFrame:
    return ped.where("mother is null and father is null").select("id")


def contributions(paths: DataFrame) -> DataFrame:
    """L(id, anc): the expected share of a person's genes from an ancestor, 1 for the person itself."""
    return paths.groupBy("id", "anc").agg(F.sum(F.col("n") * F.pow(F.lit(2.0), -F.col("gen"))).alias("l"))


def descendant_paths(ped: DataFrame, paths: DataFrame) -> DataFrame:
    """Directed paths to all descendants; an overflow raises, since sums of LONG are checked in ANSI mode."""
    got = paths.where("gen > 0").groupBy("anc").agg(F.sum("n").alias("n"))
    return ped.select("id").join(got, F.col("id") == F.col("anc"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n_descendant_paths"))


def distinct_ancestors(ped: DataFrame, paths: DataFrame) -> DataFrame:
    got = paths.where("gen > 0").select("id", "anc").distinct().groupBy("id").agg(F.count("*").alias("n"))
    return ped.select("id").join(got, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_distinct_ancestors"))


def founder_ancestors(ped: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct founders in the ancestry; a founder counts itself."""
    own = founders(ped).withColumnRenamed("id", "anc")
    got = paths.join(own, "anc", "left_semi").select("id", "anc").distinct().groupBy("id").agg(F.count("*").alias("n"))
    return ped.select("id").join(got, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_founder_ancestors"))


def ecg(ped: DataFrame, paths: DataFrame) -> DataFrame:
    """Equivalent complete generations: the sum of 2^-gen over all ancestors' paths."""
    got = paths.where("gen > 0").groupBy("id").agg(F.sum(F.col("n") * F.pow(F.lit(2.0), -F.col("gen"))).alias("ecg"))
    return ped.select("id").join(got, "id", "left").select("id", F.coalesce("ecg", F.lit(0.0)).alias("ecg"))


def inbreeding(ped: DataFrame, shares: DataFrame, depth: DataFrame) -> DataFrame:
    """id, F and D (the Mendelian variance): F = sum of L^2 D over the ancestry - 1, depth by depth, since D needs the parents' F.

    As soon as a depth is done, its ancestors' terms L^2 D are added up for all their descendants, so each share is read
    and joined once.
    """
    rows = stored(ped.select("id", "mother", "father").join(depth, "id"), "by-depth")
    last = rows.agg(F.max("depth")).first()[0]
    if last is None:
        return rows.select("id", F.lit(0.0).alias("F"), F.lit(1.0).alias("D"))
    at = depth.select(F.col("id").alias("anc"), F.col("depth").alias("level"))
    terms = stored(shares.where("id != anc").join(at, "anc").select("id", "anc", "level", (F.col("l") * F.col("l")).alias("l2")), "shares")
    done: list[DataFrame] = []
    sums: list[DataFrame] = []
    for level in range(last + 1):
        here = rows.where(F.col("depth") == level).drop("depth")
        d, own = F.lit(1.0), F.lit(0.0)
        if done:
            f = reduce(DataFrame.unionByName, done).select("id", "F")
            for p in ("mother", "father"):
                here = here.join(f.select(F.col("id").alias(p), F.col("F").alias(f"F_{p}")), p, "left")
                d = d - F.when(F.col(f"F_{p}").isNotNull(), 0.25 * (1 + F.col(f"F_{p}"))).otherwise(0.0)
            above = reduce(DataFrame.unionByName, sums).groupBy("id").agg(F.sum("s").alias("s"))
            here, own = here.join(above, "id", "left"), F.coalesce("s", F.lit(0.0))
        here = here.select("id", d.alias("D"), own.alias("s")).withColumn("F", F.col("s") + F.col("D") - 1)
        done.append(stored(here.select("id", F.when(F.abs("F") < 1e-12, 0.0).otherwise(F.col("F")).alias("F"), "D"), "inbreeding"))
        if level < last:
            mine = done[-1].select(F.col("id").alias("anc"), "D")
            sums.append(stored(terms.where(F.col("level") == level).join(mine, "anc").groupBy("id").agg(F.sum(F.col("l2") * F.col("D")).alias("s")), "sums"))
    return reduce(DataFrame.unionByName, done)


def pair_kinship(pairs: DataFrame, shares: DataFrame, inbred: DataFrame) -> DataFrame:
    """kinship of each pair (id1, id2): half the sum of L1 L2 D over common ancestors."""
    one = shares.select(F.col("id").alias("id1"), "anc", F.col("l").alias("l1"))
    two = shares.select(F.col("id").alias("id2"), "anc", F.col("l").alias("l2"))
    d = inbred.select(F.col("id").alias("anc"), "D")
    ids = pairs.select("id1", "id2").distinct()
    got = ids.join(one, "id1").join(two, ["id2", "anc"]).join(d, "anc").groupBy("id1", "id2").agg((0.5 * F.sum(F.col("l1") * F.col("l2") * F.col("D"))).alias("kinship"))
    return pairs.join(got, ["id1", "id2"], "left").withColumn("kinship", F.coalesce("kinship", F.lit(0.0)))


def cohort_kinship(cohorts: DataFrame, shares: DataFrame, inbred: DataFrame) -> DataFrame:
    """Per cohort (id, cohort): size, mean F, mean kinship with and without self-pairs; no pair list is made."""
    sums = cohorts.join(shares, "id").groupBy("cohort", "anc").agg(F.sum("l").alias("s"))
    total = sums.join(inbred.select(F.col("id").alias("anc"), "D"), "anc").groupBy("cohort").agg((0.5 * F.sum(F.col("s") * F.col("s") * F.col("D"))).alias("total"))
    own = cohorts.join(inbred, "id").groupBy("cohort").agg(F.count("*").alias("size"), F.avg("F").alias("mean_F"), F.sum((1 + F.col("F")) / 2).alias("selfs"))
    n = F.col("size")
    return own.join(total, "cohort").select("cohort", "size", "mean_F", (F.col("total") / (n * n)).alias("group_kinship"), F.when(n > 1, (F.col("total") - F.col("selfs")) / (n * (n - 1))).alias("mean_kinship"))
