"""Faulty variants of the derived pedigree, one query each: status and findings of all 33 checks, in Spark and in SQL.

A variant's text columns are expressions that both engines read; parsing and checking are written twice, here in SQL.
Between them the variants make every check fail at least once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.plans import validation
from kinfold.plans.derived import pedigree
from kinfold.session import stored

_TEXT = "CAST({} AS STRING)"
#: Columns of a faultless variant.
_PLAIN = {
    "id": _TEXT.format("id"),
    "sex": "sex",
    "mother": f"coalesce({_TEXT.format('mother')}, '-1')",
    "father": f"coalesce({_TEXT.format('father')}, '.')",
    "birth_year": "CAST(1900 + CAST(floor(id / 40) AS INT) AS STRING)",
    "birth_date": "CASE WHEN id % 3 = 0 THEN concat(CAST(1900 + CAST(floor(id / 40) AS INT) AS STRING), '-', right(concat('0', CAST(1 + id % 12 AS STRING)), "
        "2), '-', right(concat('0', CAST(1 + id % 28 AS STRING)), 2)) ELSE '' END",
    "twin_set": "CASE WHEN id >= 48 AND id % 100 < 2 THEN concat('s', CAST(CAST(floor(id / 100) AS INT) AS STRING)) END",
    "zygosity": "CASE WHEN id >= 48 AND id % 100 < 2 THEN 'MZ' END",
}
_BORN = {"birth_year": "birth_year", "birth_date": "birth_date"}
_TWINS = {"multiple_birth": "twin_set", "zygosity": "zygosity"}
_LIMITS = {"min_parent_age": 12, "max_parent_age": 80, "max_children_mother": 10, "max_children_father": 10, "birth_year_max": 2026}


@dataclass(frozen=True)
class Scenario:
    """``columns`` replace those of the faultless variant (None: absent); ``more`` are rows that stand a second time, and
    their sex; ``skip`` are the checks that are skipped."""

    columns: dict[str, str | None] = field(default_factory=dict)
    rows: str = "1 = 1"
    more: str | None = None
    options: dict = field(default_factory=dict)
    skip: tuple[str, ...] = ()
    faults: tuple[tuple[str, int], ...] = ()


_ALL = tuple(c.name for c in validation.CHECKS)


def _after(*failed: str, off: tuple[str, ...] = ()) -> tuple[str, ...]:
    """What is skipped once these checks fail and those are off."""
    stopped = {*failed, *off}
    for c in validation.CHECKS:
        if stopped & set(c.needs):
            stopped.add(c.name)
    return tuple(n for n in _ALL if n in stopped and n not in failed)


_NO_BREAKS = ("cycle_breaks", "role_conflict_breaks")
_NO_BIRTHS = ("birth_year_dtype", "birth_date_dtype", "zygosity_tokens", "birth_year_range", "birth_year_topology", "birth_date_range", "birth_date_year_consistency", "birth_date_topology", "multiple_birth_sets", "mz_links")
_SWAPPED = "CASE WHEN sex = 'F' THEN 'M' ELSE 'F' END"
_ROLES = {
    # 2 has no recorded sex, 4 has one, and both are mothers and fathers; 0 and two others are parents without a row.
    "sex": f"CASE WHEN id = 2 THEN 'U' WHEN id % 43 = 7 THEN {_SWAPPED} ELSE sex END",
    "mother": "CASE WHEN id < 48 THEN '-1' WHEN id % 53 = 9 THEN concat('9', CAST(1000000 + id AS STRING)) WHEN id % 61 = 12 THEN '70000000' WHEN id % 71 "
        "= 13 THEN '2' WHEN id % 73 = 14 THEN '4' ELSE CAST(mother AS STRING) END",
    "father": "CASE WHEN id < 48 THEN '.' WHEN id % 59 = 11 THEN concat('8', CAST(1000000 + id AS STRING)) WHEN id % 67 = 13 THEN '70000000' WHEN id % 71 "
        "= 14 THEN '2' WHEN id % 73 = 15 THEN '4' WHEN id % 79 = 21 THEN CAST(id AS STRING) WHEN id % 83 = 22 THEN CAST(mother AS STRING) ELSE "
        "CAST(father AS STRING) END",
}
_CYCLES = {
    # 20 and 22 are each other's mother, and what follows from them; births are out of order, out of range and at odds.
    "mother": "CASE WHEN id = 20 THEN '22' WHEN id = 22 THEN '20' ELSE coalesce(CAST(mother AS STRING), '-1') END",
    "birth_year": "CASE WHEN id = 22 THEN '1930' WHEN id % 61 = 3 THEN '2500' WHEN id % 67 = 4 THEN '' ELSE CAST(1900 + CAST(floor(id / 40) AS INT) AS STRING) END",
    "birth_date": "CASE WHEN id % 97 = 9 THEN '2400-05-06' WHEN id = 22 THEN '' WHEN id % 3 = 0 OR id % 7 = 0 THEN concat(CAST(1900 + CAST(floor(id / 40) AS "
        "INT) + CASE WHEN id % 89 = 6 THEN 1 ELSE 0 END AS STRING), '-', right(concat('0', CAST(1 + id % 12 AS STRING)), 2), '-', right(concat('0', "
        "CAST(1 + id % 28 AS STRING)), 2)) ELSE '' END",
    "twin_set": "CASE WHEN id >= 48 AND id % 100 < 2 THEN concat('s', CAST(CAST(floor(id / 100) AS INT) AS STRING)) WHEN id >= 48 AND id % 40 IN (8, 9) THEN "
        "concat('t', CAST(CAST(floor(id / 40) AS INT) AS STRING)) END",
    "zygosity": "CASE WHEN id >= 48 AND id % 100 < 2 THEN 'MZ' WHEN id % 40 = 8 THEN 'DZ' WHEN id % 101 = 60 THEN 'MZ' END",
}
SCENARIOS: dict[str, Scenario] = {
    "checks_absent_columns": Scenario(columns={"zygosity": None, "birth_date": None}, options=_BORN | _TWINS, skip=_after("required_columns"), faults=(("required_columns", 2),)),
    "checks_empty_table": Scenario(rows="1 = 0", options=_BORN | _TWINS, skip=_NO_BREAKS + ("parent_child_count",), faults=(("empty_pedigree", 1),)),
    "checks_tokens": Scenario(
        columns={
            "id": "CASE WHEN id % 101 = 7 THEN ' ' ELSE CAST(id AS STRING) END",
            "sex": "CASE WHEN id % 103 = 9 THEN 'Q' ELSE sex END",
            "birth_year": "CASE WHEN id % 107 = 11 THEN 'x' ELSE '1950' END",
            "birth_date": "CASE WHEN id % 109 = 13 THEN '2000-13-01' ELSE '1950-02-03' END",
            "zygosity": "CASE WHEN id % 113 = 15 THEN 'TZ' ELSE 'NA' END",
        },
        options=_BORN | _TWINS,
        skip=_after("id_dtype", "sex_tokens", "birth_year_dtype", "birth_date_dtype", "zygosity_tokens", off=_NO_BREAKS),
    ),
    "checks_ids": Scenario(
        columns={
            "id": "CASE WHEN id % 127 = 5 THEN CAST(-id AS STRING) ELSE CAST(id AS STRING) END",
            "mother": "CASE WHEN id % 137 = 60 THEN '-7' ELSE coalesce(CAST(mother AS STRING), '-1') END",
            "father": "CASE WHEN id % 139 = 61 THEN '-9' ELSE coalesce(CAST(father AS STRING), '.') END",
        },
        more="id % 131 = 6",
        skip=_after("negative_ids", "duplicate_ids", "parent_token_range_mother", "parent_token_range_father", off=_NO_BREAKS + _NO_BIRTHS + ("parent_child_count",)),
    ),
    "checks_roles": Scenario(
        columns=_ROLES, rows="id <> 0", more="id % 97 = 2 AND id > 4", options={k: v for k, v in _LIMITS.items() if k.startswith("max_ch")},
        skip=_after("zero_parent_present", "parents_distinct", off=_NO_BREAKS + _NO_BIRTHS),
    ),
    "checks_recorded_sex": Scenario(columns=_ROLES, rows="id <> 0", options={"override_asserted_sex": False, "sex_check": False}, skip=_after("parents_distinct", off=_NO_BREAKS + _NO_BIRTHS + ("parent_child_count", "parent_refs_sex_conflict", "sex_role_override"))),
    "checks_births": Scenario(columns=_CYCLES, options=_BORN | _TWINS | _LIMITS, skip=_NO_BREAKS),
    "checks_breaks": Scenario(
        columns=_CYCLES | {"father": "CASE WHEN id >= 48 AND id % 73 = 15 THEN '4' WHEN id % 79 = 21 THEN CAST(id AS STRING) ELSE coalesce(CAST(father AS STRING), '.') END"},
        options=_BORN | {"break_cycles": True, "break_role_conflicts": True}, skip=("zygosity_tokens", "parent_child_count", "multiple_birth_sets", "mz_links"),
    ),
}


def raw_table(spark: SparkSession, sf_dir: str, s: Scenario) -> DataFrame:
    ped = pedigree(spark, sf_dir).where(s.rows)
    columns = _PLAIN | s.columns
    named = [F.expr(e).alias(n) for n, e in columns.items() if e is not None]
    out = ped.select((2 * F.col("id")).alias("row"), *named)
    if s.more:
        again = [F.expr(e if n != "sex" or s.more.endswith("4") else _SWAPPED).alias(n) for n, e in columns.items() if e is not None]
        out = out.unionByName(ped.where(s.more).select((2 * F.col("id") + 1).alias("row"), *again))
    return out


def by_check(report: validation.Report) -> DataFrame:
    """check, status, n, n_refs: a row for each of the 33 checks."""
    found = report.findings.groupBy("check").agg(F.count("*").alias("n"), F.sum("n_refs").alias("n_refs"))
    status = report.findings.sparkSession.createDataFrame(list(report.status.items()), "check string, status string")
    return status.join(found, "check", "left").select("check", "status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    s = SCENARIOS[name]
    return lambda spark, sf_dir: by_check(validation.validate(stored(raw_table(spark, sf_dir, s), "faulty"), validation.Options(**s.options)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(name) for name in SCENARIOS}


# The same in SQL -----------------------------------------------------------------------------------------------------

_NONE = "('', 'NA', 'NAN', 'N/A', '.', '?', 'NONE', 'NULL')"


def _typed(s: Scenario) -> str:
    columns = _PLAIN | s.columns
    plain = ", ".join(f"{e or 'NULL'} AS {n}" for n, e in columns.items())
    out = f"raw AS (SELECT 2 * id AS row, {plain} FROM ped WHERE {s.rows}"
    if s.more:
        again = ", ".join(f"{(e if n != 'sex' or s.more.endswith('4') else _SWAPPED) or 'NULL'} AS {n}" for n, e in columns.items())
        out += f" UNION ALL SELECT 2 * id + 1, {again} FROM ped WHERE ({s.rows}) AND ({s.more})"
    parent = "TRY_CAST(CASE WHEN upper(trim({0})) NOT IN " + _NONE + " AND trim({0}) <> '-1' THEN trim({0}) END AS BIGINT) AS {0}"
    return (
        out
        + f"""),
typ AS (SELECT row, TRY_CAST(id AS BIGINT) AS id, CASE WHEN sex IN ('F', 'M') THEN sex END AS sex, {parent.format('mother')}, {parent.format('father')},
  TRY_CAST(birth_year AS INT) AS birth_year, TRY_CAST(birth_date AS DATE) AS birth_date, CASE WHEN zygosity IN ('MZ', 'DZ') THEN zygosity END AS zyg, twin_set AS grp FROM raw),
src0 AS (SELECT *, row = min(row) OVER (PARTITION BY id, sex, mother, father, birth_year, birth_date, zyg, grp) AS own FROM typ),
src1 AS (SELECT * FROM src0 WHERE own),
el AS (SELECT id AS child, mother AS parent FROM src1 WHERE mother IN (SELECT id FROM src1) UNION SELECT id, father FROM src1 WHERE father IN (SELECT id FROM src1)),
reach AS (SELECT child, parent FROM el UNION SELECT r.child, e.parent FROM reach r JOIN el e ON e.child = r.parent),
late AS (SELECT l.id, l.role, l.parent FROM (SELECT id, 'mother' AS role, mother AS parent FROM src1 UNION ALL SELECT id, 'father', father FROM src1) l JOIN src1 c ON c.id = l.id JOIN src1 p ON p.id = l.parent
  WHERE l.id = l.parent OR (EXISTS (SELECT 1 FROM reach r WHERE r.child = l.parent AND r.parent = l.id)
    AND CASE WHEN c.birth_date IS NOT NULL AND p.birth_date IS NOT NULL THEN p.birth_date > c.birth_date ELSE coalesce(p.birth_year, year(p.birth_date)) > coalesce(c.birth_year, year(c.birth_date)) END))"""
    )


def _cleared(s: Scenario) -> str:
    """Links that the two breaking checks remove."""
    if not s.options.get("break_cycles"):
        return ",\nwrong AS (SELECT id, '' AS role FROM src1 WHERE false),\nsrc AS (SELECT * FROM src1)"
    less = ("SELECT row, id, sex, CASE WHEN (id, 'mother') NOT IN (SELECT id, role FROM {0}) THEN mother END AS mother, CASE WHEN (id, 'father') NOT IN "
        "(SELECT id, role FROM {0}) THEN father END AS father, birth_year, birth_date, zyg, grp FROM {1}")
    return f""",
src2 AS ({less.format("late", "src1")}),
apart2 AS (SELECT * FROM src2 WHERE mother IS DISTINCT FROM father),
wrong AS (SELECT c.id, CASE WHEN p.sex = 'F' THEN 'father' ELSE 'mother' END AS role FROM src2 p JOIN apart2 c ON c.father = p.id AND p.sex = 'F' OR c.mother = p.id AND p.sex = 'M'
  WHERE p.sex IS NOT NULL AND p.id IN (SELECT mother FROM apart2) AND p.id IN (SELECT father FROM apart2)),
src AS ({less.format("wrong", "src2")})"""


def _found(s: Scenario) -> dict[str, str]:
    """Per check: a query of its findings' n_refs, one row each."""
    o = validation.Options(**s.options)
    ages = f"age < {o.min_parent_age}" + (f" OR age > {o.max_parent_age} + " if o.max_parent_age else "")
    by_year, by_date = (ages + ("1" if o.max_parent_age else ""), ages + ("0" if o.max_parent_age else ""))
    both = "coalesce(am, false) AND coalesce(af, false)"
    out = {
        "id_dtype": "SELECT 0 FROM raw WHERE trim(id) = ''",
        "sex_tokens": "SELECT 0 FROM raw WHERE sex = 'Q'",
        "birth_year_dtype": "SELECT 0 FROM raw WHERE birth_year = 'x'",
        "birth_date_dtype": "SELECT 0 FROM raw WHERE birth_date = '2000-13-01'",
        "zygosity_tokens": "SELECT 0 FROM raw WHERE zygosity = 'TZ'",
        "duplicate_rows": "SELECT 0 FROM src0 WHERE NOT own",
        "negative_ids": "SELECT 0 FROM src1 WHERE id < 0",
        "duplicate_ids": "SELECT 0 FROM src1 GROUP BY id HAVING count(*) > 1",
        "parent_token_range_mother": "SELECT 0 FROM src1 WHERE mother < -1",
        "parent_token_range_father": "SELECT 0 FROM src1 WHERE father < -1",
        "zero_parent_present": "SELECT count(*) FROM (SELECT 'm' AS role FROM src1 WHERE mother = 0 UNION ALL SELECT 'f' FROM src1 WHERE father = 0) WHERE NOT EXISTS "
            "(SELECT 1 FROM src1 WHERE id = 0) GROUP BY role",
        "cycle_breaks": "SELECT 0 FROM late",
        "role_conflict_breaks": "SELECT 0 FROM wrong",
        "parent_refs_present_mother": "SELECT rm FROM per WHERE row IS NULL AND rm > 0",
        "parent_refs_present_father": "SELECT rf FROM per WHERE row IS NULL AND rf > 0",
        "parent_child_count": " UNION ALL ".join(f"SELECT {r} FROM per WHERE {r} > {n}" for r, n in (("rm", o.max_children_mother), ("rf", o.max_children_father)) if n),
        "parent_refs_sex_conflict": "SELECT rm + rf FROM per WHERE row IS NULL AND rm > 0 AND rf > 0",
        "sex_role_ambiguity": "SELECT 0 FROM per WHERE row IS NOT NULL AND sex IS NULL AND rm > 0 AND rf > 0",
        "parent_role_conflict": f"SELECT 0 FROM per WHERE row IS NOT NULL AND sex IS NOT NULL AND {both}",
        "self_loops": "SELECT 0 FROM src WHERE id = mother OR id = father",
        "parents_distinct": "SELECT 0 FROM src WHERE mother = father",
        "sex_role_override": "SELECT 0 FROM imp WHERE sex_source = 'role'",
        "sex_role_consistency": f"SELECT 0 FROM imp WHERE sex_source IN ('input', 'role') AND NOT ({both}) AND ((rm > 0 AND now <> 'F') OR (rf > 0 AND now <> 'M'))",
        "acyclic": "SELECT DISTINCT 0, child FROM (SELECT child FROM reach2 WHERE parent IN (SELECT child FROM reach2 WHERE child = parent) UNION SELECT child "
            "FROM reach2 WHERE child = parent)",
        "birth_year_range": f"SELECT 0 FROM src WHERE birth_year NOT BETWEEN {o.birth_year_min} AND {o.birth_year_max}",
        "birth_year_topology": f"SELECT 0 FROM aged WHERE NOT dated AND ({by_year.replace('age', 'by_year')})",
        "birth_date_range": f"SELECT 0 FROM src WHERE year(birth_date) NOT BETWEEN {o.birth_year_min} AND {o.birth_year_max}",
        "birth_date_year_consistency": "SELECT 0 FROM src WHERE year(birth_date) <> birth_year",
        "birth_date_topology": f"SELECT 0 FROM aged WHERE dated AND ({by_date.replace('age', 'by_date')})",
        "multiple_birth_sets": "SELECT 0 FROM src WHERE grp IN (SELECT grp FROM badset)",
        "mz_links": "SELECT 0 FROM mz WHERE grp IS NULL OR k <> 2 OR sexes > 1",
    }
    return {k: v.replace("SELECT DISTINCT 0, child", "SELECT 0") for k, v in out.items() if v and k not in s.skip}


def _override(s: Scenario) -> str:
    return "TRUE" if s.options.get("override_asserted_sex", True) else "FALSE"


def sql(name: str, ped: str) -> str:
    """DuckDB SQL of a scenario; ``ped`` are the CTEs of the derived pedigree."""
    s = SCENARIOS[name]
    checks = ", ".join(f"('{c}', {str(c in s.skip).lower()})" for c in _ALL)
    parts = [f"SELECT '{k}' AS \"check\", v.x::BIGINT AS n_refs FROM ({q}) v(x)" for k, q in _found(s).items()] if not any(c == "required_columns" for c, _ in s.faults) else []
    parts += [f"SELECT '{c}' AS \"check\", 0::BIGINT AS n_refs FROM range({n})" for c, n in s.faults]
    body = f"""
SELECT c."check", CASE WHEN c.skip THEN 'SKIP' WHEN f.n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, coalesce(f.n, 0)::BIGINT AS n, coalesce(f.n_refs, 0)::BIGINT AS n_refs
FROM (VALUES {checks}) c("check", skip) LEFT JOIN (SELECT "check", count(*) AS n, sum(n_refs) AS n_refs FROM f GROUP BY 1) f ON f."check" = c."check" """
    return f"""WITH RECURSIVE{ped},
{_typed(s)}{_cleared(s)},
lnk AS (SELECT id, 'mother' AS role, mother AS parent, mother IS DISTINCT FROM father AS apart FROM src WHERE mother IS NOT NULL UNION ALL SELECT id, 'father', father, mother IS DISTINCT FROM father FROM src WHERE father IS NOT NULL),
refs AS (SELECT parent AS id, count(*) FILTER (role = 'mother') AS rm, count(*) FILTER (role = 'father') AS rf, bool_or(role = 'mother' AND apart) AS am, bool_or(role = 'father' AND apart) AS af FROM lnk GROUP BY 1),
per AS (SELECT coalesce(s.id, r.id) AS id, s.* EXCLUDE (id), coalesce(r.rm, 0) AS rm, coalesce(r.rf, 0) AS rf, r.am, r.af FROM src s FULL JOIN refs r ON r.id = s.id),
rol AS (SELECT *, CASE WHEN rm > 0 AND rf = 0 THEN 'F' WHEN rf > 0 AND rm = 0 THEN 'M' END AS role FROM per WHERE row IS NOT NULL),
imp AS (SELECT *, CASE WHEN sex <> role AND {_override(s)} THEN role ELSE coalesce(sex, role) END AS now, CASE WHEN sex IS NULL AND role IS NOT NULL THEN 'missing' WHEN sex IS NULL THEN 'unresolved' WHEN sex <> role AND {_override(s)} THEN 'role' ELSE 'input' END AS sex_source FROM rol),
el2 AS (SELECT id AS child, mother AS parent FROM src WHERE mother IN (SELECT id FROM src) UNION SELECT id, father FROM src WHERE father IN (SELECT id FROM src)),
reach2 AS (SELECT child, parent FROM el2 UNION SELECT r.child, e.parent FROM reach2 r JOIN el2 e ON e.child = r.parent),
aged AS (SELECT c.birth_date IS NOT NULL AND p.birth_date IS NOT NULL AS dated, coalesce(c.birth_year, year(c.birth_date)) - coalesce(p.birth_year, year(p.birth_date)) AS by_year,
  year(c.birth_date) - year(p.birth_date) - ((month(c.birth_date), day(c.birth_date)) < (month(p.birth_date), day(p.birth_date)))::INT AS by_date FROM lnk l JOIN src c ON c.id = l.id JOIN src p ON p.id = l.parent),
gaps AS (SELECT *, birth_date - lag(birth_date) OVER (PARTITION BY grp ORDER BY birth_date NULLS FIRST) AS gap FROM src WHERE grp IS NOT NULL),
setagg AS (SELECT grp, count(*) AS k, count(DISTINCT mother) AS ms, count(DISTINCT father) AS fs, count(*) FILTER (mother IS NULL AND father IS NULL) AS orphans, max(gap) AS gap, count(birth_date) AS dates, count(DISTINCT coalesce(birth_year, year(birth_date))) AS years FROM gaps GROUP BY grp),
badset AS (SELECT grp FROM setagg WHERE k < 2 OR ms > 1 OR fs > 1 OR (orphans > 0 AND orphans < k) OR gap > 7 OR (dates < k AND years > 1)),
marked AS (SELECT id, now, CASE WHEN grp NOT IN (SELECT grp FROM badset) THEN grp END AS grp FROM imp WHERE zyg = 'MZ'),
mz AS (SELECT m.*, t.k, t.sexes FROM marked m LEFT JOIN (SELECT grp, count(*) AS k, count(DISTINCT now) AS sexes FROM marked WHERE grp IS NOT NULL GROUP BY grp) t USING (grp)),
f AS ({" UNION ALL ".join(parts) or "SELECT '' AS " + chr(34) + "check" + chr(34) + ", 0 AS n_refs WHERE false"}){body}"""


def cycles_sql(ped: str) -> str:
    """Members of cycles, each named by its least id."""
    reach = _typed(SCENARIOS["checks_births"])
    return (f"WITH RECURSIVE{ped},\n{reach} SELECT a.child AS id, min(a.parent) AS cycle FROM reach a JOIN reach b ON b.child = a.parent AND b.parent = "
        f"a.child WHERE a.child IN (SELECT child FROM reach WHERE child = parent) GROUP BY 1")


def oracle_sql(ped: str) -> dict[str, str]:
    return {name: sql(name, ped) for name in SCENARIOS} | {"cycle_members": cycles_sql(ped)}
