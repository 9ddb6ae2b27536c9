"""One-hop relatives and the individual table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.families import Families
from kinfold.operators.graph import edges, pedigree_components, structural_depth
from kinfold.session import stored

COLUMNS = ("id", "sex", "sex_source", "mother", "father", "ped_depth", "is_founder", "F", "n_full_sibs", "n_mat_half_sibs", "n_pat_half_sibs", "n_offspring", "n_mates", "component_id", "n_grandparents", "n_grandchildren", "n_uncles_aunts", "n_first_cousins", "n_distinct_ancestors", "n_descendant_paths", "n_founder_ancestors", "ecg")


def mating_pairs(ped: DataFrame) -> DataFrame:
    """mother, father, n_offspring over rows with both parents known."""
    return ped.where("mother is not null and father is not null").groupBy("mother", "father").agg(F.count("*").alias("n_offspring"))


def offspring_counts(ped: DataFrame) -> DataFrame:
    return edges(ped).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_offspring"))


_SIBS = ("n_full_sibs", "n_mat_half_sibs", "n_pat_half_sibs", "n_offspring", "n_mates")
_HOPS = (*_SIBS, "n_grandparents", "n_grandchildren", "n_uncles_aunts", "n_first_cousins")


def sibs_and_offspring(ped: DataFrame) -> DataFrame:
    """id, mother, father and the counts of sibs, offspring and mates."""
    pairs = stored(mating_pairs(ped), "mating-pairs")
    as_parent = {p: ped.where(f"{p} is not null").groupBy(p).agg(F.count("*").alias(f"of_{p}")) for p in ("mother", "father")}
    mates = pairs.select(F.explode(F.array("mother", "father")).alias("id")).groupBy("id").agg(F.count("*").alias("n_mates"))
    offspring = offspring_counts(ped)
    out = ped.select("id", "mother", "father")
    for p, n in as_parent.items():
        out = out.join(n, p, "left")
    out = out.join(pairs.withColumnRenamed("n_offspring", "both"), ["mother", "father"], "left").join(offspring, "id", "left").join(mates, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    fs = zero(F.col("both") - 1)
    out = out.select(
        "id", "mother", "father", fs.alias("n_full_sibs"),
        zero(F.col("of_mother") - 1 - fs).alias("n_mat_half_sibs"), zero(F.col("of_father") - 1 - fs).alias("n_pat_half_sibs"),
        zero(F.col("n_offspring")).alias("n_offspring"), zero(F.col("n_mates")).alias("n_mates"),
    )
    return stored(out, "one-hop")


def one_hop(ped: DataFrame) -> DataFrame:
    """id and the counts of relatives that follow from parents, grandparents and mates."""
    out = sibs_and_offspring(ped)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # What a parent passes on: its known parents, its full sibs, and these sibs' offspring.
    siblings = ped.select("id", "mother", "father").join(out.select("id", F.col("n_offspring").alias("own"), "n_full_sibs"), "id")
    by_pair = siblings.where("mother is not null and father is not null").groupBy("mother", "father").agg(F.sum("own").alias("all"))
    up = siblings.join(by_pair, ["mother", "father"], "left").select("id", (F.col("mother").isNotNull().cast("int") + F.col("father").isNotNull().cast("int")).alias("gp"), F.col("n_full_sibs").alias("fs"), zero(F.col("all") - F.col("own")).alias("nn"))
    for p in ("mother", "father"):
        side = up.select(F.col("id").alias(p), *(F.col(c).alias(f"{c}_{p}") for c in ("gp", "fs", "nn")))
        out = out.join(side, p, "left")
    total = lambda c: (zero(F.col(f"{c}_mother")) + zero(F.col(f"{c}_father"))).cast("long")
    links = edges(ped).select("child", "parent").distinct()
    down = links.alias("x").join(links.alias("y"), F.col("x.parent") == F.col("y.child")).select(F.col("y.parent").alias("id"), F.col("x.child").alias("grandchild")).distinct()
    down = down.groupBy("id").agg(F.count("*").alias("n_grandchildren"))
    out = out.join(down, "id", "left")
    return out.select("id", "n_full_sibs", "n_mat_half_sibs", "n_pat_half_sibs", "n_offspring", "n_mates", total("gp").alias("n_grandparents"), zero(F.col("n_grandchildren")).alias("n_grandchildren"), total("fs").alias("n_uncles_aunts"), total("nn").alias("n_first_cousins"))


def individual_table(ped: DataFrame, with_inbreeding: bool = True, families: Families | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``columns`` for every person, and only the parts they need; without inbreeding, ``F`` and ``n_distinct_ancestors`` drop out.

    The parts are joined in two steps, so that no task sorts for all joins at once.
    """
    wanted = {"id", *columns} - (set() if with_inbreeding else {"F", "n_distinct_ancestors"})
    families = Families(ped, stored(structural_depth(ped), "depth")) if families is None else families
    source = F.col("sex_source") if "sex_source" in ped.columns else F.when(F.col("sex").isNull(), "unresolved").otherwise("input")
    out = ped.select("id", "sex", source.alias("sex_source"), "mother", "father", (F.col("mother").isNull() & F.col("father").isNull()).alias("is_founder"))
    if wanted & {"F", "n_distinct_ancestors", "n_founder_ancestors", "ecg"}:
        out = out.join(families.persons.withColumnRenamed("depth", "ped_depth").drop("D"), "id", "left")
    elif "ped_depth" in wanted:
        out = out.join(families.depth.withColumnRenamed("depth", "ped_depth"), "id", "left")
    if "n_descendant_paths" in wanted:
        out = out.join(families.descendant_paths(), "id", "left").withColumn("n_descendant_paths", F.coalesce("n_descendant_paths", F.lit(0)))
    out = stored(out.select(*(c for c in out.columns if c in wanted)), "persons-and-descendants")
    if wanted & set(_HOPS):
        out = out.join(sibs_and_offspring(ped).select("id", *_SIBS) if wanted & set(_HOPS) <= set(_SIBS) else stored(one_hop(ped), "one-hop-counts"), "id", "left")
    if "component_id" in wanted:
        out = out.join(stored(pedigree_components(ped).withColumnRenamed("component", "component_id"), "components"), "id", "left")
    return out.select(*(c for c in COLUMNS if c in wanted))
