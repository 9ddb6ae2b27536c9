"""The Fixed Pedigree, phantom parents, and reduction to a valid pedigree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.births import birth_sets, number_by_first_row
from kinfold.operators.graph import cycle_components, structural_depth
from kinfold.plans.validation import Options, Report, absent_parents, validate
from kinfold.session import numbered, stored


def synthesized_founders(ped: DataFrame, sex_check: bool = True) -> DataFrame:
    """A founder for each parent without a row; its sex is its role's, F for both roles without the sex check."""
    gone = absent_parents(ped).groupBy(F.col("parent").alias("id")).agg(F.bool_or(F.col("role") == "mother").alias("m"), F.bool_or(F.col("role") == "father").alias("f"))
    sex = F.when(F.col("m") & ~F.col("f"), "F").when(F.col("f") & ~F.col("m"), "M")
    return gone.select("id", (sex if sex_check else sex.otherwise("F")).alias("sex"))


def phantom_parents(ped: DataFrame, integer: bool, missing: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Half-founders get a new founder in the empty slot, numbered by row past every id; the pedigree and the new founders."""
    half = ped.where("(mother is null) != (father is null)").select("row", F.when(F.col("mother").isNull(), "mother").otherwise("father").alias("slot"))
    numbers = numbered(half, "row", name="k")
    if integer:
        top = ped.agg(F.max(F.greatest("id", F.coalesce("mother", "id"), F.coalesce("father", "id")))).first()[0] or 0
        top = max([top, *(int(t) for t in missing if t.lstrip("-").isdigit())])
        numbers = numbers.withColumn("new", F.col("k") + F.lit(top))
    else:
        numbers = numbers.withColumn("new", F.concat(F.lit("_phantom_"), F.col("k")))
    out = ped.join(numbers, "row", "left")
    for slot in ("mother", "father"):
        out = out.withColumn(slot, F.when(F.col("slot") == slot, F.col("new")).otherwise(F.col(slot)))
    new = numbers.select(F.col("new").alias("id"), F.when(F.col("slot") == "mother", "F").otherwise("M").alias("sex"))
    return out.drop("slot", "k", "new"), new


# What a Fixed Pedigree says of where a sex comes from.
SEX_SOURCES = ("input", "imputed_from_missing", "imputed_from_role", "unresolved")


def keep_recorded_source(ped: DataFrame, raw: DataFrame) -> DataFrame:
    """The input's own ``sex_source`` where this run would say ``input``; a column with other values is ignored.

    A Fixed Pedigree read again has every sex resolved, and a filled one would else pass for a recorded one.
    """
    if "sex_source" not in raw.columns or "sex_source" not in ped.columns:
        return ped
    own = raw.select("row", F.trim("sex_source").alias("_said"))
    if own.where(F.col("_said").isNotNull() & ~F.col("_said").isin(*SEX_SOURCES)).limit(1).count():
        return ped
    return ped.join(own, "row", "left").withColumn("sex_source", F.when((F.col("sex_source") == "input") & F.col("_said").isNotNull(), F.col("_said")).otherwise(F.col("sex_source"))).drop("_said")


def fix(report: Report, fill_half_founders: bool = False, find_twins: int | None = None) -> DataFrame:
    """The repaired rows and the added founders, with ``ped_depth``; sets are renumbered by their first row."""
    c = report.context
    ped, added = keep_recorded_source(c.ped, c.raw), synthesized_founders(c.ped, c.options.sex_check)
    if fill_half_founders:
        ped, new = phantom_parents(ped, c.integer, c.options.missing_parent)
        added = added.unionByName(new)
    if find_twins is not None:
        sets = birth_sets(ped, find_twins).withColumn("set", F.col("set").cast("string"))
        ped = ped.drop("set").join(sets, "id", "left")
    number = number_by_first_row(ped)
    ped = ped.join(number, "set", "left").withColumn("set", F.col("number")).drop("number")
    added = added.withColumn("sex_source", F.when(F.col("sex").isNull(), "unresolved").otherwise("imputed_from_missing"))
    whole = stored(added.unionByName(ped, allowMissingColumns=True), "fixed")
    return whole.join(structural_depth(whole).withColumnRenamed("depth", "ped_depth"), "id", "left")


@dataclass
class Reduction:
    report: Report
    rows: DataFrame
    dropped: DataFrame
    rounds: int


def reduce_pedigree(raw: DataFrame, options: Options, most: int | None = None) -> Reduction:
    """Drop offending ids until a round finds none: (id, check, round) lists them; links to a dropped id become -1.

    Of ``acyclic`` only members of cycles are dropped.  Each round drops at least one id, so rows + 1 rounds suffice.
    """
    dropped = raw.sparkSession.createDataFrame([], "id string, check string, round int")
    now, k = stored(raw, "reduced"), 0
    limit = most or now.count() + 1
    while True:
        k += 1
        report = validate(now, options)
        bad = report.findings.where(F.col("check").isin(*report.failed("block_or_drop", "keep_or_drop"))).where("id is not null").select("id", "check").distinct()
        go = bad.where("check != 'acyclic'").select("id")
        if "acyclic" in report.failed("block_or_drop"):
            go = go.unionByName(cycle_components(report.context.ped, report.context.depths()).select(F.col("id").cast("string").alias("id")))
        bad = stored(bad.join(go.distinct(), "id", "left_semi").select("id", "check", F.lit(k).alias("round")), "dropped")
        if bad.isEmpty() or k > limit or report.failed("block"):
            return Reduction(report, now, dropped, k)
        dropped = dropped.unionByName(bad)
        ids = bad.select("id").distinct()
        own = F.regexp_replace(F.col(options.id), r"^\s+|\s+$", "")
        now = now.join(ids, own == ids["id"], "left_anti") if options.id != "id" else now.join(ids.withColumnRenamed("id", "_gone"), own == F.col("_gone"), "left_anti")
        for p in (options.mother, options.father):
            gone = ids.select(F.col("id").alias("_gone"))
            now = now.join(gone, F.col(p) == F.col("_gone"), "left").withColumn(p, F.when(F.col("_gone").isNotNull(), "-1").otherwise(F.col(p))).drop("_gone")
        now = stored(now, "reduced")


def verify(written: DataFrame) -> Report:
    """Check a Fixed Pedigree as it was written; a check that fails here is a bug of the repairs, not of the input."""
    raw = written if "row" in written.columns else written.withColumn("row", F.monotonically_increasing_id())
    return validate(stored(raw, "written"), Options(allow_missing_sex=True, override_asserted_sex=False))


def exit_code(report: Report, dropped: DataFrame | None = None) -> int:
    """0 clean, 1 findings or drops, 2 blocked."""
    if report.failed("block", "block_or_drop"):
        return 2
    return int(bool(report.failed("autofix", "keep_or_drop")) or (dropped is not None and not dropped.isEmpty()))
