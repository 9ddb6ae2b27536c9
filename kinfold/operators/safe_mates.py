"""What a mate correlation may release: couples and the people behind them, by the cells that analyse them.

The unit behind a count of couples is a person: a count is backed by the smaller of its distinct mothers and fathers.  A
*cell* is a pair of traits, mother's and father's.  Couples are grouped by which cells analyse them; one small group shuts
every cell, since with the total and the cells' counts it follows by subtraction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.disclosure import check_min_cell
from kinfold.session import stored

#: What a released cell holds; extremes, sizes of networks and drop counts are never released.
FIELDS = ("estimator", "n", "estimate", "se", "ci_low", "ci_high")
WITHHELD = "withheld"


def cells(traits: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a in traits for b in traits]


def gates(pairs: DataFrame, people: DataFrame, traits: list[str], tables: dict[tuple[str, str], bool] | None = None) -> DataFrame:
    """gate, cell, n, units.  ``pairs`` has m_x and f_x of every couple, ``people`` (id and the traits) every individual;
    ``tables`` says which cells are fitted to a table of levels."""
    used = {(a, b): F.col(f"m_{a}").isNotNull() & F.col(f"f_{b}").isNotNull() for a, b in cells(traits)}
    marks = F.concat_ws(",", *(F.when(v, f"{a}x{b}") for (a, b), v in used.items()))
    both = stored(pairs.withColumn("cells", marks), "couples")
    units = F.least(F.countDistinct("mother"), F.countDistinct("father"))
    part = lambda gate, df: df.select(F.lit(gate).alias("gate"), "cell", "n", "units")
    out = [
        part("couples", both.agg(F.count("*").alias("n"), units.alias("units")).withColumn("cell", F.lit(""))),
        part("couples_by_cells", both.groupBy(F.col("cells").alias("cell")).agg(F.count("*").alias("n"), units.alias("units"))),
    ]
    named = both.select("mother", "father", F.explode(F.filter(F.split("cells", ","), lambda c: c != "")).alias("cell"))
    out.append(part("cell", named.groupBy("cell").agg(F.count("*").alias("n"), units.alias("units"))))
    for (a, b), fitted in (tables or {}).items():
        if fitted:
            level = F.concat(F.lit(f"{a}x{b}:"), F.format_number(f"m_{a}", 0), F.lit("/"), F.format_number(f"f_{b}", 0))
            out.append(part("levels", both.where(used[a, b]).groupBy(level.alias("cell")).agg(F.count("*").alias("n"), units.alias("units"))))
    role = both.select(F.explode(F.array(F.struct(F.col("mother").alias("id"), F.lit("mothers").alias("role")), F.struct(F.col("father").alias("id"), F.lit("fathers").alias("role")))).alias("e")).select("e.*").distinct()
    rows = stored(people.join(role, "id", "left").withColumn("role", F.coalesce("role", F.lit("others"))), "roles")
    out.append(part("individuals", rows.groupBy(F.col("role").alias("cell")).agg(F.count("*").alias("n")).withColumn("units", F.col("n"))))
    for t in traits:
        state = F.concat(F.lit(f"{t}:"), F.col("role"), F.when(F.col(t).isNull(), ":missing").otherwise(":with_value"))
        out.append(part("trait_rows", rows.groupBy(state.alias("cell")).agg(F.count("*").alias("n")).withColumn("units", F.col("n"))))
    return reduce(DataFrame.unionByName, out)


def decisions(table: DataFrame, min_cell: int, tables: dict[tuple[str, str], bool], traits: list[str]) -> DataFrame:
    """cell, released: every group of couples is large enough, the cell is, and so is each level it is fitted to."""
    check_min_cell(min_cell)
    small = F.count_if((F.col("n") > 0) & (F.least("n", "units") < min_cell)) > 0
    shut = table.select("gate", F.substring_index("cell", ":", 1).alias("of"), "n", "units").groupBy("gate", "of").agg(small.alias("small")).collect()  # some cells and gates
    bad = {(r["gate"], r["of"]) for r in shut if r["small"]}
    seen = {(r["gate"], r["of"]) for r in shut}
    groups = any(g in ("couples", "couples_by_cells") for g, _ in bad)
    rows = []
    for a, b in cells(traits):
        name = f"{a}x{b}"
        rows.append((name, ("cell", name) in seen and not groups and ("cell", name) not in bad and not (tables.get((a, b)) and ("levels", name) in bad)))
    return table.sparkSession.createDataFrame(rows, "cell string, released boolean")


def release(results: dict[str, dict], decided: DataFrame) -> dict[str, dict]:
    """Per cell the listed fields, or none of them."""
    passed = {r["cell"]: r["released"] for r in decided.collect()}
    return {c: {f: got.get(f) for f in FIELDS} if passed.get(c) else {"estimate": None, "reason": WITHHELD} for c, got in results.items()}
