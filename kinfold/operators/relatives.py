"""The long-form table of relatives per person and kind, and the list of relative pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kind, nominal kinship, directional (junior first).
KINDS = {"PO": (0.25, True), "FS": (0.25, False), "HS": (0.125, False), "mHS": (0.125, False), "pHS": (0.125, False), "Av": (0.125, True), "1G": (0.125, True), "1C": (0.0625, False), "MZ": (0.5, False), "MO": (0.25, True), "FO": (0.25, True), "mAv": (0.125, True), "pAv": (0.125, True)}
DEFAULT = ("PO", "FS", "HS", "mHS", "pHS", "Av", "1G", "1C")
_FROM_CODES = {"PO": ("MO", "FO"), "FS": ("FS",), "HS": ("MHS", "PHS"), "mHS": ("MHS",), "pHS": ("PHS",), "Av": ("Av",), "1G": ("GP",), "1C": ("1C",), "MZ": ("MZ",), "MO": ("MO",), "FO": ("FO",)}
CLOSE = 1 / 16


def lineage_avuncular(ped: DataFrame, couples: DataFrame, role: str) -> DataFrame:
    """Child and full sib of its mother (father); none where the child's parents (``couples``: mother, father, kinship) are
    as close as ``CLOSE``."""
    apart = couples.where(F.col("kinship") < CLOSE).select("mother", "father")
    full = ped.where("mother is not null and father is not null").select("id", F.col("mother").alias("m"), F.col("father").alias("f"))
    sibs = full.alias("x").join(full.alias("y"), ["m", "f"]).where("x.id != y.id").select(F.col("x.id").alias(role), F.col("y.id").alias("sib"))
    either = ped.join(apart, ["mother", "father"], "left_semi").unionByName(ped.where("mother is null or father is null"))
    return either.join(sibs, role).select(F.col("id").alias("id1"), F.col("sib").alias("id2")).distinct()


def relative_pairs(pairs: DataFrame, kinds: tuple[str, ...] = DEFAULT, lineage: dict[str, DataFrame] | None = None) -> DataFrame:
    """id1, id2, kind, kinship from classified pairs; mAv and pAv come from ``lineage``."""
    mapping = F.create_map(*(F.lit(x) for c in sorted({c for k in kinds for c in _FROM_CODES.get(k, ())}) for x in (c, "+".join(k for k in kinds if c in _FROM_CODES.get(k, ())))))
    out = pairs.withColumn("kind", F.explode(F.split(F.try_element_at(mapping, F.col("code")), r"\+"))).select("id1", "id2", "kind")
    for k, df in (lineage or {}).items():
        if k in kinds:
            out = out.unionByName(df.select("id1", "id2", F.lit(k).alias("kind")))
    nominal = F.create_map(*(F.lit(x) for k in kinds for x in (k, KINDS[k][0])))
    return out.select("id1", "id2", "kind", F.element_at(nominal, F.col("kind")).alias("kinship"))


def skeleton(ped: DataFrame, relatives: DataFrame, kinds: tuple[str, ...] = DEFAULT, depth: DataFrame | None = None, base_year: int = 1900, drop_founders: bool = False) -> DataFrame:
    """A row for every kind and person: id, kind, number of relatives, year of birth, and four columns to be filled in.

    A directional pair counts for the junior, a symmetric one for both.
    """
    direct = [k for k in kinds if KINDS[k][1]]
    sides = F.when(F.col("kind").isin(*direct), F.array("id1")).otherwise(F.array("id1", "id2")) if direct else F.array("id1", "id2")
    counts = relatives.select("kind", F.explode(sides).alias("id")).groupBy("kind", "id").agg(F.count("*").cast("int").alias("n_relatives"))
    people = ped.where("mother is not null or father is not null") if drop_founders else ped
    year = F.col("birth_year") if "birth_year" in ped.columns else F.lit(None).cast("int")
    if depth is not None:
        people = people.join(depth, "id", "left")
        year = F.coalesce(year, F.lit(base_year) + F.col("depth"))
    sex = F.when(F.col("sex") == "M", 1).when(F.col("sex") == "F", 2).otherwise(0)
    rows = people.select("id", sex.cast("tinyint").alias("sex"), year.cast("smallint").alias("born_at_year"), F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    none = F.lit(None)
    return rows.join(counts, ["kind", "id"], "left").select("kind", "id", "sex", "born_at_year", F.coalesce("n_relatives", F.lit(0)).alias("n_relatives"), none.cast("tinyint").alias("failure_status"), none.cast("int").alias("failure_time"), none.cast("tinyint").alias("relatives_status"), none.cast("int").alias("relatives_time"))


def relationship_diagnostics(skeleton_: DataFrame) -> DataFrame:
    """Per kind: people with a relative, and the mean number among them."""
    n = F.col("n_relatives")
    return skeleton_.groupBy("kind").agg(F.count_if(n > 0).alias("n_with_relative"), F.avg(F.when(n > 0, n)).alias("mean_among_them"))
