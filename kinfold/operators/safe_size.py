"""What the eight estimators of effective size may release: the counts each rests on, and which results they let pass.

A *gate* is a small table of counts.  It is open if every count in it is 0 or at least the minimum cell.  Results are
released in groups, all fields of a group or none, if all gates of the group are open.  Gates themselves are never written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.disclosure import check_min_cell
from kinfold.operators.effective_size import hill_by_cohort, parent_ages
from kinfold.operators.graph import edges
from kinfold.operators.sections import INBRED, family_id
from kinfold.session import stored

_FAMILY = ("depth_by_sex", "fathers_by_depth", "mothers_by_depth")
_F = ("inbred_by_depth", "inbred_f_by_depth")
_KIN = ("depth", "genomes_by_depth", "related_families_by_depth")
_REFERENCE = ("reference_used", "reference_inbred")

#: Estimator: groups of released fields, with the gates of each.  Long-term contributions are never released: they tell how
#: descendants are spread over founders, whatever the counts.
RELEASES: dict[str, dict[str, tuple[tuple[str, ...], tuple[str, ...]]]] = {
    "inbreeding": {"estimate": (("ne", "slope", "n_cohorts", "reason"), ("depth", *_F))},
    "coancestry": {"estimate": (("ne", "slope", "n_cohorts", "reason"), _KIN)},
    "group_coancestry": {"estimate": (("ne", "slope", "n_cohorts", "reason"), (*_KIN, *_F, "cotwins_by_depth"))},
    "sex_ratio": {"estimate": (("ne", "n_cohorts"), ("depth_by_sex",))},
    "variance_family_size": {"estimate": (("ne", "n_cohorts"), _FAMILY)},
    "individual_delta_f": {
        "estimate": (("ne", "se", "reason"), _REFERENCE),
        "unrelated_founders": (("ne_unrelated_founders",), (*_REFERENCE, "reference_past_first_generation")),
        "reference": (("n_reference",), ("reference_used", "reference_not_used")),
    },
    "long_term_contributions": {},
    "hill_overlapping": {"estimate": (("ne", "ne_m", "ne_f", "n_cohorts"), ("cohort_by_sex", "fathers_by_cohort", "mothers_by_cohort", "links_with_birth_years", "parents_with_birth_years"))},
}
NOT_RELEASED, WITHHELD = "not_released_in_safe_mode", "withheld"


def _table(gate: str, df: DataFrame, cell: Column, n: Column) -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), cell.cast("string").alias("cell"), n.cast("long").alias("n"))


def _related_families(ped: DataFrame, depth: DataFrame, copies: DataFrame | None, cohorts: DataFrame) -> DataFrame:
    """Per depth, a lower bound of the units behind its related pairs: families of those with a sib at their depth, or the
    parents that two of them share, whichever are fewer; at least 1 where there is any kinship, else 0."""
    own = ped.select("id", "mother", "father").join(depth, "id").join(family_id(ped), "id")
    if copies is not None:
        own = own.join(copies.select(F.col("id2").alias("id")), "id", "left_anti")
    shared, sibs = [], []
    for p in ("mother", "father"):
        of = own.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("parent"), "depth").agg(F.count("*").alias("k")).where("k > 1")
        shared.append(of.groupBy("depth").agg(F.count("*").alias("shared")))
        sibs.append(own.join(of.select(F.col("parent").alias(p), "depth"), [p, "depth"], "left_semi").select("depth", "family"))
    families = sibs[0].unionByName(sibs[1]).distinct().groupBy("depth").agg(F.count("*").alias("families"))
    parents = shared[0].unionByName(shared[1]).groupBy("depth").agg(F.sum("shared").alias("shared"))
    got = cohorts.select(F.col("cohort").alias("depth"), "mean_kinship").join(families, "depth", "left").join(parents, "depth", "left")
    units = F.greatest(F.least(F.coalesce("families", F.lit(0)), F.coalesce("shared", F.lit(0))), F.lit(1))
    return got.select("depth", F.when(F.coalesce("mean_kinship", F.lit(0.0)) > 1e-12, units).otherwise(0).alias("n"))


def gates(ped: DataFrame, depth: DataFrame, persons: DataFrame, cohorts: DataFrame, twins: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """gate, cell, n.  ``persons`` holds id, F and ecg; ``cohorts`` is the kinship by depth; ``twins`` are linked pairs (id1 < id2); ``reference`` (id,
    reference) replaces the last depth."""
    who = ped.join(depth, "id").join(persons.select("id", "F", "ecg"), "id")
    who = who.withColumn("copy", F.lit(False)) if twins is None else who.join(twins.select(F.col("id2").alias("id"), F.lit(True).alias("copy")), "id", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    named = edges(ped).groupBy(F.col("parent").alias("id")).agg(*(F.bool_or(F.col("role") == p).alias(f"is_{p}") for p in ("mother", "father")))
    who = who.join(named, "id", "left").withColumns({f"is_{p}": F.coalesce(f"is_{p}", F.lit(False)) for p in ("mother", "father")})
    if reference is None:
        who = who.join(F.broadcast(depth.agg(F.max("depth").alias("last"))), F.lit(True)).withColumn("reference", F.col("depth") == F.col("last")).drop("last")  # one row
    else:
        who = who.join(reference, "id", "left").withColumn("reference", F.coalesce("reference", F.lit(False)))
    who = stored(who, "gated")
    male, female, kin = F.col("sex") == "M", F.col("sex") == "F", F.col("F") > INBRED
    by = who.groupBy("depth").agg(
        F.count("*").alias("depth_n"), F.count_if(~F.col("copy")).alias("genomes"), F.count_if("copy").alias("copies"), F.count_if(male).alias("male"), F.count_if(female).alias("female"),
        F.count_if(male & F.col("is_father")).alias("fathers"), F.count_if(female & F.col("is_mother")).alias("mothers"), F.count_if(kin).alias("inbred"), F.count_if(F.col("ecg") > 0).alias("used"),
    )
    by = stored(by, "gates-by-depth")
    d = F.col("depth")
    parts = [_table(g, by, d, F.col(c)) for g, c in (("depth", "depth_n"), ("genomes_by_depth", "genomes"), ("cotwins_by_depth", "copies"), ("fathers_by_depth", "fathers"), ("mothers_by_depth", "mothers"), ("inbred_by_depth", "inbred"), ("delta_f_used_by_depth", "used"))]
    parts += [_table("depth_by_sex", by, F.concat(d, F.lit(f"/{s}")), F.col(s)) for s in ("male", "female")]
    values = who.where(kin).groupBy("depth", F.round("F", 9).alias("v")).agg(F.count("*").alias("n"))
    parts.append(_table("inbred_f_by_depth", values, F.concat(d, F.lit("/"), F.format_string("%.9f", "v")), F.col("n")))
    parts.append(_table("related_families_by_depth", _related_families(ped, depth, twins, cohorts), d, F.col("n")))
    ref, grown = F.col("reference"), F.col("ecg") > 0
    one = who.agg(F.count_if(ref & grown).alias("used"), F.count_if(~(ref & grown)).alias("rest"), F.count_if(ref & kin).alias("inbred"), F.count_if(ref & (F.col("ecg") > 1)).alias("past"))
    parts += [_table(g, one, F.lit(""), F.col(c)) for g, c in (("reference_used", "used"), ("reference_not_used", "rest"), ("reference_inbred", "inbred"), ("reference_past_first_generation", "past"))]
    if "birth_year" in ped.columns:
        born = ped.where("birth_year is not null").select(F.col("id").alias("parent"))
        ages = parent_ages(ped)
        links = ages.groupBy("role").agg(F.count("*").alias("n"))
        parts.append(_table("links_with_birth_years", links, F.col("role"), F.col("n")))
        kids = ped.where("birth_year is not null").select(F.explode(F.array(F.struct(F.lit("M").alias("role"), F.col("father").alias("parent")), F.struct(F.lit("F").alias("role"), F.col("mother").alias("parent")))).alias("e")).select("e.*")
        parents = kids.join(born, "parent", "left_semi").groupBy("role").agg(F.countDistinct("parent").alias("n"))
        parts.append(_table("parents_with_birth_years", parents, F.col("role"), F.col("n")))
        years = hill_by_cohort(ped).select("birth_year")
        used = who.join(F.broadcast(years), "birth_year")  # a row per birth year
        cells = used.groupBy("birth_year").agg(F.count_if(male).alias("male"), F.count_if(female).alias("female"), F.count_if(male & F.col("is_father")).alias("fathers"), F.count_if(female & F.col("is_mother")).alias("mothers"))
        cells = stored(cells, "gates-by-cohort")
        y = F.col("birth_year")
        parts += [_table("cohort_by_sex", cells, F.concat(y, F.lit(f"/{s}")), F.col(s)) for s in ("male", "female")]
        parts += [_table(f"{p}_by_cohort", cells, y, F.col(p)) for p in ("fathers", "mothers")]
    return reduce(DataFrame.unionByName, parts)


def open_gates(table: DataFrame, min_cell: int) -> DataFrame:
    """gate, open."""
    check_min_cell(min_cell)
    return table.groupBy("gate").agg(F.bool_and((F.col("n") == 0) | (F.col("n") >= min_cell)).alias("open"))


def decisions(table: DataFrame, min_cell: int) -> DataFrame:
    """estimator, part, released: a gate without counts is shut."""
    is_open = {r["gate"]: r["open"] for r in open_gates(table, min_cell).collect()}  # some twenty gates
    rows = [(e, g, all(is_open.get(x, False) for x in needs)) for e, groups in RELEASES.items() for g, (_, needs) in groups.items()]
    return table.sparkSession.createDataFrame(rows, "estimator string, part string, released boolean")


def release(results: dict[str, dict], decided: DataFrame) -> dict[str, dict]:
    """The estimators' results without what is withheld; what isn't listed is never copied."""
    passed = {(r["estimator"], r["part"]): r["released"] for r in decided.collect()}
    out: dict[str, dict] = {}
    for e, got in results.items():
        if not RELEASES[e]:
            out[e] = {"ne": None, "reason": NOT_RELEASED}
            continue
        out[e] = {}
        for part, (fields, _) in RELEASES[e].items():
            ok = passed.get((e, part), False) or got.get("reason") == "unknown_sex"
            out[e] |= {f: got.get(f) if ok else None for f in fields if f in got}
            if not ok and part == "estimate":
                out[e]["reason"] = WITHHELD
    return out
