"""The sections of the summary: each is one small DataFrame from one or two aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.distributions import distribution, effective_count, inbreeding_bin, share
from kinfold.operators.individual import mating_pairs

#: F above this counts as inbred.
INBRED = 1e-9
#: Columns of the individual table that the distribution report covers.
REPORTED = ("n_full_sibs", "n_mat_half_sibs", "n_pat_half_sibs", "n_offspring", "n_mates", "n_grandparents", "n_grandchildren", "n_uncles_aunts", "n_first_cousins", "n_distinct_ancestors", "n_descendant_paths", "n_founder_ancestors", "ecg", "F")


def numeric_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.agg(*distribution(column))


def distributions(individual: DataFrame, columns: tuple[str, ...] = REPORTED) -> DataFrame:
    """A row for each reported column; the columns are stacked first, so all are done in one pass and one shuffle."""
    have = [c for c in columns if c in individual.columns]
    long = individual.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in have))).alias("v")).select("v.*")
    return long.groupBy("variable").agg(*distribution("value"))


def size_structure(ped: DataFrame, depth: DataFrame, components: DataFrame) -> DataFrame:
    """One row of scalars on size, parentage, depth and components."""
    m, f = F.col("mother").isNotNull(), F.col("father").isNotNull()
    base = ped.agg(
        F.count("*").alias("n_individuals"), F.count_if(F.col("sex") == "F").alias("n_females"), F.count_if(F.col("sex") == "M").alias("n_males"), F.count_if(F.col("sex").isNull()).alias("n_unknown_sex"),
        F.count_if(~m & ~f).alias("n_founders"), F.count_if(m | f).alias("n_nonfounders"), F.count_if(m).alias("n_mother_links"), F.count_if(f).alias("n_father_links"),
        F.count_if(m & f).alias("n_both_parents"), F.count_if(m != f).alias("n_one_parent"), F.count_if(m & ~f).alias("n_mother_only"), F.count_if(~m & f).alias("n_father_only"),
    )
    of_depth = depth.agg(F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), F.percentile(F.col("depth").cast("double"), 0.5).alias("median_depth"), F.countDistinct("depth").alias("n_depths"))
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    of_size = sizes.agg(F.count("*").alias("n_components"), F.max("size").alias("largest_component"), F.count_if(F.col("size") == 1).alias("n_singletons"), F.avg("size").alias("mean_component"))
    return base.join(of_depth, F.lit(True)).join(of_size, F.lit(True))  # three single rows


def depth_counts(depth: DataFrame) -> DataFrame:
    return depth.groupBy("depth").agg(F.count("*").alias("n"))


def largest_components(components: DataFrame, most: int = 6) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(most)


def mating_pair_summary(ped: DataFrame) -> DataFrame:
    return mating_pairs(ped).agg(F.count_if(F.col("n_offspring") > 1).alias("n_multi_child_pairs"), effective_count("n_offspring").alias("effective_pairs"), *distribution("n_offspring"))


def sibship_sizes(ped: DataFrame) -> DataFrame:
    n = F.col("n_offspring")
    q = lambda p: F.percentile(n.cast("double"), p)
    return mating_pairs(ped).agg(F.count("*").alias("n_sibships"), F.avg(n).alias("mean"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), *(share(n == k).alias(f"share_{k}") for k in (1, 2, 3)), share(n >= 4).alias("share_4plus"))


def reproduction(individual: DataFrame) -> DataFrame:
    """Reproductive and terminal persons and offspring, overall ('all') and by sex."""
    n = F.col("n_offspring")
    both = F.col("mother").isNotNull() & F.col("father").isNotNull()
    rows = individual.withColumn("sex", F.coalesce("sex", F.lit("unknown"))).withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("sex"))))
    return rows.groupBy("stratum").agg(
        F.count("*").alias("n"), F.count_if(n > 0).alias("n_reproductive"), F.count_if(n == 0).alias("n_terminal"),
        F.avg(F.when(both, (F.col("n_full_sibs") > 0).cast("double"))).alias("full_sib_fraction"),
        F.avg("n_offspring").alias("mean_offspring"), F.avg("n_mates").alias("mean_mates"),
        *(share(n == k).alias(f"offspring_{k}") for k in range(4)), share(n >= 4).alias("offspring_4plus"),
    )


def genealogy(individual: DataFrame) -> DataFrame:
    return distributions(individual, ("n_descendant_paths", "n_distinct_ancestors"))


def founder_contribution(individual: DataFrame) -> DataFrame:
    n = F.col("n_descendant_paths")
    return individual.where("is_founder").agg(F.count_if(n > 0).alias("n_with_descendants"), F.count_if(n == 0).alias("n_without_descendants"), effective_count(n).alias("effective_founders"), *distribution(n))


def founder_summary(ped: DataFrame, paths: DataFrame, depth: DataFrame) -> DataFrame:
    """By depth: active founders, effective founders (by descendants in that depth), mean founder ancestors."""
    first = ped.where("mother is null and father is null").select(F.col("id").alias("anc"))
    reach = paths.join(first, "anc", "left_semi").select("id", "anc").distinct().join(depth, "id")
    per_founder = reach.groupBy("depth", "anc").agg(F.count("*").alias("descendants"))
    out = per_founder.groupBy("depth").agg(F.count("*").alias("active_founders"), effective_count("descendants").alias("effective_founders"))
    per_person = reach.groupBy("depth", "id").agg(F.count("*").alias("k")).groupBy("depth").agg(F.count("*").alias("n"), F.avg("k").alias("mean_founder_ancestors"))
    return per_person.join(out, "depth").select("depth", "n", "active_founders", "effective_founders", "mean_founder_ancestors")


def component_summary(components: DataFrame) -> DataFrame:
    size = F.col("size")
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    bins = (("1", size == 1), ("2", size == 2), ("3_9", size.between(3, 9)), ("10_99", size.between(10, 99)), ("100plus", size >= 100))
    return sizes.agg(*(share(c).alias(f"share_{b}") for b, c in bins), *distribution("size"))


def _stratum(individual: DataFrame, by: str) -> DataFrame:
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    out = individual.groupBy(by).agg(F.count("*").alias("n"), F.count_if("is_founder").alias("n_founders"), F.count_if(F.col("n_offspring") > 0).alias("n_reproductive"), mean("n_offspring"), mean("n_mates"), mean("n_full_sibs"), F.avg("F").alias("mean_F"), F.count_if(F.col("F") > 1e-9).alias("n_inbred"))
    return out


def sex_summary(individual: DataFrame) -> DataFrame:
    return _stratum(individual.withColumn("sex", F.coalesce("sex", F.lit("unknown"))), "sex")


def depth_summary(individual: DataFrame) -> DataFrame:
    return _stratum(individual, "ped_depth")


def inbreeding_summary(individual: DataFrame) -> DataFrame:
    f = F.col("F")
    inbred = f > 1e-9
    return individual.agg(F.count_if(inbred).alias("n_inbred"), share(inbred).alias("fraction"), F.avg(f).alias("mean"), F.avg(F.when(inbred, f)).alias("mean_inbred"), F.max(f).alias("max"))


def inbreeding_histogram(individual: DataFrame) -> DataFrame:
    return individual.groupBy(inbreeding_bin(F.col("F")).alias("bin")).agg(F.count("*").alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def unit_support(df: DataFrame, cell: str, unit: str) -> DataFrame:
    """Distinct units behind each cell's count."""
    return df.groupBy(cell).agg(F.countDistinct(unit).alias("units"))


def family_id(ped: DataFrame) -> DataFrame:
    """id and family: rows with the same recorded parents share one; a parentless row is its own."""
    key = F.when(F.col("mother").isNull() & F.col("father").isNull(), F.concat(F.lit("i"), F.col("id"))).otherwise(F.concat(F.lit("f"), F.coalesce(F.col("mother").cast("string"), F.lit("-")), F.lit("/"), F.coalesce(F.col("father").cast("string"), F.lit("-"))))
    return ped.select("id", key.alias("family"))
