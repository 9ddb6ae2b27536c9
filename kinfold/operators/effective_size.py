"""Effective population size: eight estimators.  Cohorts are depths; each result is a small table.

A scalar that can't be given is null, with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ESTIMATORS = ("inbreeding", "coancestry", "group_coancestry", "sex_ratio", "variance_family_size", "individual_delta_f", "long_term_contributions", "hill_overlapping")


def _regressed(cohorts: DataFrame, column: str, first: int) -> DataFrame:
    """Ne = -1 / (2 slope) of ln(1 - value) on depth."""
    rows = cohorts.where(F.col(column).isNotNull() & (F.col("cohort") >= first) & (F.col(column) < 1))
    slope = F.regr_slope(F.ln(1 - F.col(column)), F.col("cohort").cast("double"))
    out = rows.agg(slope.alias("slope"), F.count("*").alias("n"))
    ne = F.when(F.col("slope") < 0, -1 / (2 * F.col("slope")))
    reason = F.when(F.col("n") < 2, "too_few_cohorts").when(ne.isNull(), "no_increase")
    return out.select(ne.alias("ne"), F.col("slope"), F.col("n").alias("n_cohorts"), reason.alias("reason"))


def ne_inbreeding(cohorts: DataFrame) -> DataFrame:
    return _regressed(cohorts, "mean_F", 1)


def ne_coancestry(cohorts: DataFrame) -> DataFrame:
    return _regressed(cohorts, "mean_kinship", 1)


def ne_group_coancestry(cohorts: DataFrame) -> DataFrame:
    return _regressed(cohorts, "group_kinship", 1)


def transitions(cohorts: DataFrame, column: str = "mean_F") -> DataFrame:
    """Per depth: Ne from the change since the depth before, null where there is no increase.

    The window runs over one row per depth, not over persons.
    """
    before = F.lag(column).over(W.orderBy("cohort"))
    delta = (F.col(column) - before) / (1 - before)
    return cohorts.withColumn("delta", delta).select("cohort", "delta", F.when(F.col("delta") > 0, 1 / (2 * F.col("delta"))).alias("ne"))


def harmonic(c: Column) -> Column:
    """Harmonic mean of the values given; null if any is 0 or none is."""
    return F.when(F.min(c) > 0, F.count(c) / F.sum(1 / c))


def sex_ratio_by_depth(ped: DataFrame, depth: DataFrame) -> DataFrame:
    got = ped.join(depth, "id").groupBy("depth").agg(F.count_if(F.col("sex") == "M").alias("males"), F.count_if(F.col("sex") == "F").alias("females"))
    m, f = F.col("males"), F.col("females")
    return got.select("depth", "males", "females", F.when((m > 0) & (f > 0), 4 * m * f / (m + f)).alias("ne"))


def ne_sex_ratio(ped: DataFrame, depth: DataFrame) -> DataFrame:
    return sex_ratio_by_depth(ped, depth).agg(harmonic(F.col("ne")).alias("ne"), F.count("ne").alias("n_cohorts"))


def offspring_by_sex(ped: DataFrame) -> DataFrame:
    """id, sons, daughters for every person."""
    kids = ped.select("sex", F.explode(F.array("mother", "father")).alias("parent")).where("parent is not null")
    kids = kids.groupBy("parent").agg(F.count_if(F.col("sex") == "M").alias("sons"), F.count_if(F.col("sex") == "F").alias("daughters"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return ped.select("id", "sex").join(kids, F.col("id") == F.col("parent"), "left").select("id", "sex", zero("sons").alias("sons"), zero("daughters").alias("daughters"))


def _family_variance(persons: DataFrame, cohort: str) -> DataFrame:
    """Per cohort of parents: what the variance form needs of the sons and daughters of its males and females.

    The sons' and daughters' totals are those the males leave; with both parents of one cohort the females leave as many.
    """
    parts = []
    for name, s in (("m", "M"), ("f", "F")):
        own = F.col("sex") == s
        x, y = F.when(own, F.col("sons").cast("double")), F.when(own, F.col("daughters").cast("double"))
        parts += [F.count(x).alias(f"n_{name}"), F.sum(x).alias(f"sons_{name}"), F.sum(y).alias(f"daughters_{name}"), F.avg(x).alias(f"k_{name}m"), F.avg(y).alias(f"k_{name}f"), F.var_samp(x).alias(f"v_{name}m"), F.var_samp(y).alias(f"v_{name}f"), F.covar_samp(x, y).alias(f"cov_{name}")]
    return persons.groupBy(cohort).agg(*parts)


def _relative_variance(p: str) -> Column:
    v = lambda c: F.col(f"{c}_{p}")
    km, kf = F.col(f"k_{p}m"), F.col(f"k_{p}f")
    return F.when((km > 0) & (kf > 0), F.col(f"v_{p}m") / (km * km) + F.col(f"v_{p}f") / (kf * kf) + 2 * v("cov") / (km * kf))


def variance_by_depth(ped: DataFrame, depth: DataFrame) -> DataFrame:
    """Per parents' depth: 1/Ne = 1/(8S) + 1/(8T) + V_m/(16M) + V_f/(16W)."""
    got = _family_variance(offspring_by_sex(ped).join(depth, "id"), "depth")
    got = got.withColumn("vm", _relative_variance("m")).withColumn("vf", _relative_variance("f"))
    s, t = F.col("sons_m"), F.col("daughters_m")
    inverse = F.when((s > 0) & (t > 0), 1 / (8 * s) + 1 / (8 * t) + F.col("vm") / (16 * F.col("n_m")) + F.col("vf") / (16 * F.col("n_f")))
    return got.select("depth", F.col("n_m").alias("males"), F.col("n_f").alias("females"), "vm", "vf", F.when(inverse > 0, 1 / inverse).alias("ne"))


def ne_variance_family_size(ped: DataFrame, depth: DataFrame) -> DataFrame:
    return variance_by_depth(ped, depth).agg(harmonic(F.col("ne")).alias("ne"), F.count("ne").alias("n_cohorts"))


def ne_individual_delta_f(persons: DataFrame) -> DataFrame:
    """From (id, F, ecg, depth) and an optional boolean ``reference``; the default reference is the last depth."""
    if "reference" not in persons.columns:
        last = persons.agg(F.max("depth").alias("last"))
        persons = persons.join(F.broadcast(last), F.lit(True)).withColumn("reference", F.col("depth") == F.col("last"))  # one row
    rows = persons.where("reference")
    f, g = F.col("F"), F.col("ecg")
    d = F.when(g > 0, 1 - F.pow(1 - f, 1 / g))
    u = F.when(g > 1, 1 - F.pow(1 - f, 1 / (g - 1)))
    got = rows.agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count(d).alias("n"), F.avg(u).alias("mean_u"))
    ne = F.when(F.col("mean") > 0, 1 / (2 * F.col("mean")))
    return got.select(ne.alias("ne"), (2 * ne * ne * F.col("sd") / F.sqrt("n")).alias("se"), F.when(F.col("mean_u") > 0, 1 / (2 * F.col("mean_u"))).alias("ne_unrelated_founders"), F.col("n").alias("n_reference"), F.when(F.col("n") == 0, "empty_reference").when(ne.isNull(), "no_increase").alias("reason"))


def ne_long_term_contributions(ped: DataFrame, c: DataFrame, depth: DataFrame) -> DataFrame:
    """From ``c`` (depth, founder, c), the mean share of each founder's genes in a depth."""
    last = depth.agg(F.max("depth").alias("last"))
    c = c.join(F.broadcast(last), F.lit(True)).where("depth >= last - 1")  # one row
    wide = c.groupBy("founder").agg(F.sum(F.when(F.col("depth") == F.col("last"), F.col("c")).otherwise(0.0)).alias("now"), F.sum(F.when(F.col("depth") < F.col("last"), F.col("c")).otherwise(0.0)).alias("before"))
    half = ped.agg(F.count_if(F.col("mother").isNull() != F.col("father").isNull()).alias("half"))
    got = wide.agg(F.sum(F.col("now") * F.col("now")).alias("sum_c2"), F.max(F.abs(F.col("now") - F.col("before"))).alias("max_delta_final")).join(half, F.lit(True))
    whole = F.col("half") == 0
    return got.select(F.when(whole & (F.col("sum_c2") > 0), 2 / F.col("sum_c2")).alias("ne"), F.when(whole, F.col("sum_c2")).alias("sum_c2"), F.when(whole, F.col("max_delta_final")).alias("max_delta_final"), F.when(~whole, "incomplete_parentage").alias("reason"))


def parent_ages(ped: DataFrame) -> DataFrame:
    """role, age at each child's birth, where both years are known."""
    born = ped.where("birth_year is not null").select(F.col("id").alias("parent"), F.col("birth_year").alias("born"))
    kids = ped.where("birth_year is not null").select("id", F.col("birth_year").alias("year"), F.explode(F.array(F.struct(F.lit("M").alias("role"), F.col("father").alias("parent")), F.struct(F.lit("F").alias("role"), F.col("mother").alias("parent")))).alias("e"))
    return kids.select("id", "year", "e.role", "e.parent").join(born, "parent").select("role", (F.col("year") - F.col("born")).alias("age"))


def hill_by_cohort(ped: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Per birth-year cohort: Ne = L Ne_V, with L the mean of the parents' mean ages; cohorts still having children are left out."""
    ages = parent_ages(ped)
    life = ages.agg(((F.avg(F.when(F.col("role") == "M", F.col("age"))) + F.avg(F.when(F.col("role") == "F", F.col("age")))) / 2).alias("L"), F.percentile(F.col("age").cast("double"), quantile).alias("late"))
    last = ped.agg(F.max("birth_year").alias("last_year"))
    got = _family_variance(offspring_by_sex(ped).join(ped.select("id", "birth_year"), "id").where("birth_year is not null"), "birth_year")
    got = got.withColumn("vm", _relative_variance("m")).withColumn("vf", _relative_variance("f"))
    got = got.join(F.broadcast(life), F.lit(True)).join(F.broadcast(last), F.lit(True)).where("birth_year <= last_year - late")  # single rows

    def part(p: str) -> Column:
        s, t = F.col(f"sons_{p}"), F.col(f"daughters_{p}")
        return F.when((s > 0) & (t > 0), (1 / s + 1 / t) / 16 + F.col(f"v{p}") / (16 * F.col(f"n_{p}")))

    total = part("m") + part("f")
    return got.select("birth_year", F.when(total > 0, F.col("L") / total).alias("ne"), F.when(part("m") > 0, F.col("L") / (4 * part("m"))).alias("ne_m"), F.when(part("f") > 0, F.col("L") / (4 * part("f"))).alias("ne_f"), "L")


def ne_hill_overlapping(ped: DataFrame) -> DataFrame:
    return hill_by_cohort(ped).agg(harmonic(F.col("ne")).alias("ne"), harmonic(F.col("ne_m")).alias("ne_m"), harmonic(F.col("ne_f")).alias("ne_f"), F.count("ne").alias("n_cohorts"))
