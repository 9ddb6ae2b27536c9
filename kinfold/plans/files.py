"""Queries that go through files: tables in every dialect are written to the shared folder and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import sections
from kinfold.operators.individual import individual_table
from kinfold.plans import fixing, reports, scenarios, validation
from kinfold.plans.derived import Derived, dirty, partial, pedigree
from kinfold.session import shared_dir, stored
from kinfold.sources import sinks
from kinfold.sources.delimited import read_aligned, read_table, reference_mask, sniff, trait_tokens

Query = Callable[[SparkSession, str], DataFrame]
DIALECTS = {"tab": "\t", "comma": ",", "semicolon": ";", "bar": "|", "space": "  ", "zipped": "\t"}
COLUMNS = ("id", "sex", "mother", "father")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kinfold-{name}-{uuid.uuid4().hex}"


def _text(p: DataFrame) -> DataFrame:
    """The input as text, a missing parent as 0 and a missing sex as NA; ids are one up, so that 0 is nobody."""
    parent = lambda c: F.coalesce((F.col(c) + 1).cast("string"), F.lit("-1")).alias(c)
    return p.select((F.col("id") + 1).cast("string").alias("id"), F.coalesce("sex", F.lit("NA")).alias("sex"), parent("mother"), parent("father"))


def write_lines(p: DataFrame, sep: str, gzip: bool = False) -> str:
    """One file, as input tables are, in order of id."""
    quote = (lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))) if sep == "," else F.col
    lines = _text(p).select(F.col("id").cast("long").alias("k"), F.concat_ws(sep, *(quote(c) for c in COLUMNS)).alias("value"))
    head = p.sparkSession.createDataFrame([(-1, sep.join(COLUMNS))], "k long, value string")
    path = _place(p.sparkSession, "lines")
    head.unionByName(lines).repartition(1).sortWithinPartitions("k").select("value").write.option("compression", "gzip" if gzip else "none").text(path)
    return path


def read_dialects(spark: SparkSession, sf: str) -> DataFrame:
    """Every dialect's rows: delimiter sniffing, header, quotes, white space, gzip, the reader's nulls, row numbers."""
    p, out = stored(partial(pedigree(spark, sf)), "pedigree"), None
    for name, sep in DIALECTS.items():
        got = read_table(spark, write_lines(p, sep, name == "zipped")).select(F.lit(name).alias("dialect"), "row", *COLUMNS)
        out = got if out is None else out.unionByName(got)
    return out


def sniffed_delimiters(spark: SparkSession, sf: str) -> DataFrame:
    p = stored(pedigree(spark, sf), "pedigree")
    rows = []
    for name, sep in DIALECTS.items():
        lines = spark.read.text(write_lines(p, sep, name == "zipped")).where(F.col("value").contains("mother")).first()
        rows.append((name, sniff(lines["value"]) or "blank"))
    return spark.createDataFrame(rows, "dialect string, delimiter string")


def _traits(spark: SparkSession, sf: str) -> DataFrame:
    """A second table with one row for every second person, its flags and traits as text."""
    p = pedigree(spark, sf).where("id % 2 = 0")
    flag = F.when(F.col("id") % 3 == 0, "Yes").when(F.col("id") % 3 == 1, "0").otherwise("")
    trait = F.when(F.col("id") % 5 == 0, "n/a").when(F.col("id") % 7 == 0, "-9").otherwise(F.col("segment"))
    return p.select(F.col("id").alias("row"), F.concat(F.lit(" "), F.col("id").cast("string")).alias("person"), flag.alias("flag"), trait.alias("trait"))


def aligned_column_read(spark: SparkSession, sf: str) -> DataFrame:
    return read_aligned(pedigree(spark, sf).select("id"), _traits(spark, sf), "person", ["flag"])


def reference_mask_read(spark: SparkSession, sf: str) -> DataFrame:
    return reference_mask(pedigree(spark, sf).select("id"), _traits(spark, sf), "person", "flag")


def trait_token_read(spark: SparkSession, sf: str) -> DataFrame:
    return trait_tokens(pedigree(spark, sf).select("id"), _traits(spark, sf), "person", ["trait"], ("-9",))


def _again(spark: SparkSession, path: str) -> DataFrame:
    """A written table: all parts have the header."""
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def fixed_pedigree_file(spark: SparkSession, sf: str) -> DataFrame:
    report = validation.validate(stored(dirty(spark, sf), "dirty"), DIRTY)
    path = _place(spark, "fixed")
    sinks.fixed_pedigree(fixing.fix(report), path)
    return _again(spark, path).select(F.col("id").cast("long").alias("id"), F.col("sex").cast("int").alias("sex"), F.col("mother").cast("long").alias("mother"), F.col("father").cast("long").alias("father"), "sex_source")


def verified_pedigree(spark: SparkSession, sf: str) -> DataFrame:
    """The written pedigree checked again: what fails is a bug, not a finding."""
    report = validation.validate(stored(dirty(spark, sf), "dirty"), DIRTY)
    path = _place(spark, "fixed")
    sinks.fixed_pedigree(fixing.fix(report), path)
    again = fixing.verify(_again(spark, path))
    return scenarios.by_check(again)


def annotated_file(spark: SparkSession, sf: str) -> DataFrame:
    """The individual table with the input's other columns; sex clashes and gets a suffix."""
    p = stored(partial(pedigree(spark, sf)), "pedigree")
    raw = p.select(F.col("id").cast("string").alias("person"), F.coalesce("sex", F.lit("U")).alias("sex"), "segment", F.col("id").alias("row"))
    path = _place(spark, "annotated")
    sinks.write_delimited(sinks.annotated(individual_table(p, False), raw, "person"), path, gzip=True)
    got = _again(spark, path)
    return got.select(F.col("id").cast("long").alias("id"), "sex", "sex_input", "segment", F.col("n_offspring").cast("long").alias("n_offspring"), F.col("is_founder").cast("boolean").alias("is_founder"))


def long_report_file(spark: SparkSession, sf: str) -> DataFrame:
    """A nested report as section, key, subkey, value."""
    d = Derived(spark, sf)
    depth = {str(r["depth"]): {"n": r["n"]} for r in sections.depth_counts(d.depth).collect()}
    sex = {r["sex"]: r["n"] for r in d.ped.groupBy("sex").agg(F.count("*").alias("n")).collect()}
    path = _place(spark, "long")
    sinks.write_delimited(sinks.long_table(spark, {"structure": {"sex": sex, "depth_n": {k: v["n"] for k, v in depth.items()}}, "strata": {"by": depth}}), path)
    return _again(spark, path).na.fill("")


def validation_log_file(spark: SparkSession, sf: str) -> DataFrame:
    report = validation.validate(stored(dirty(spark, sf), "dirty"), DIRTY)
    path = _place(spark, "log")
    sinks.write_delimited(report.findings, path)
    return _again(spark, path).groupBy("check").agg(F.count("*").alias("n"))


def cleared_links(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of links that the breaking checks removed."""
    s = scenarios.SCENARIOS["checks_breaks"]
    got = reports.validate(stored(scenarios.raw_table(spark, sf, s), "faulty"), validation.Options(**s.options))
    path = _place(spark, "cleared")
    sinks.write_delimited(got.tables["cleared"], path)
    return _again(spark, path).select(F.col("id").cast("long").alias("id"), "role", F.col("parent").cast("long").alias("parent"), "reason")


_CLEAN = "id\tsex\tmother\tfather\tyear\tx\n1\tM\t-1\t-1\t1950\t1.5\n2\tF\t-1\t-1\t1951\t2\n3\tM\t2\t1\t1980\t3\n4\tF\t2\t1\t1982\t4\n"
_TABLES = {"clean": _CLEAN, "absent parent": _CLEAN + "5\tF\t9\t1\t1983\t5\n", "equal parents": _CLEAN + "5\tF\t2\t2\t1983\t5\n"}
#: Command, table, further options, exit code, files that it writes.
COMMANDS = (
    ("summarize", "clean", "", 0, "annotated.tsv summarize.extra.yaml summarize.log summarize.yaml"),
    ("summarize", "equal parents", "", 2, "summarize.log"),
    ("summarize", "clean", "--safe-attempt", 0, "summarize.log summarize.yaml"),
    ("summarize", "clean", "--id-log", 2, ""),
    ("validate", "clean", "--birth-year-col year", 0, "validate.log validate.tsv validate.yaml"),
    ("validate", "absent parent", "", 1, "validate.log validate.tsv validate.yaml"),
    ("validate", "equal parents", "", 2, "validate.log validate.yaml"),
    ("validate", "equal parents", "--drop-offending", 1, "validate.dropped.tsv validate.log validate.tsv validate.yaml"),
    ("validate", "clean", "--break-cycles", 2, ""),
    ("effective-size", "clean", "--birth-year-col year", 0, "effective-size.log effective-size.yaml"),
    ("effective-size", "clean", "--safe-attempt", 0, "effective-size.log effective-size.yaml"),
    ("effective-size", "clean", "--estimators ne_none", 2, ""),
    ("assortative-mating", "clean", "--trait x x", 2, ""),
    ("relatives-input", "clean", "--pairs", 0, "pairs.tsv relatives-input.log relatives-input.yaml skeleton.tsv"),
)


def command_codes(spark: SparkSession) -> list[tuple[str, str, int, str]]:
    """Each command's exit code and the files that it left."""
    import contextlib
    import io
    from pathlib import Path

    from kinfold import cli

    base = Path(_place(spark, "commands").removeprefix("file://"))
    out = []
    for i, (command, table, options, _, _) in enumerate(COMMANDS):
        folder = base / str(i)
        folder.mkdir(parents=True)
        (folder / "in.tsv").write_text(_TABLES[table])
        with contextlib.redirect_stderr(io.StringIO()):
            try:
                code = cli.run([command, "--in", str(folder / "in.tsv"), "--out", str(folder / "out"), *options.split()])
            except SystemExit as e:
                code = int(e.code or 0)
        files = sorted(p.name for p in (folder / "out").iterdir()) if (folder / "out").exists() else []
        out.append((command, f"{table} {options}".strip(), code, " ".join(files)))
    return out


#: Options for the dirty variant.
DIRTY = validation.Options(birth_year="birth_year", multiple_birth="twin_set", zygosity="zygosity", birth_year_max=2026, min_parent_age=12, max_parent_age=80, max_children_mother=10, max_children_father=10)


def queries() -> dict[str, Query]:
    own = (read_dialects, sniffed_delimiters, aligned_column_read, reference_mask_read, trait_token_read, fixed_pedigree_file, verified_pedigree, annotated_file, long_report_file, validation_log_file, cleared_links)
    return {f.__name__: f for f in own}


PARTIAL = """,
part AS (SELECT id, CASE WHEN id % 23 <> 7 THEN sex END AS sex, CASE WHEN id % 17 <> 3 THEN mother END AS mother, CASE WHEN id % 19 <> 5 THEN father END AS father, acctbal, segment FROM ped)"""
_PERSON = """,
two AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'Yes' WHEN id % 3 = 1 THEN '0' ELSE '' END AS flag, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN NULL ELSE segment END AS trait FROM ped WHERE id % 2 = 0)"""


def oracle_sql(ped: str, dirty_: str, fixed: str, log: str) -> dict[str, str]:
    """``ped``, ``dirty_``: CTEs of the derived pedigree and its dirty variant; ``fixed``, ``log``: queries over the latter."""
    dialects = ", ".join(f"('{d}')" for d in DIALECTS)
    names = ", ".join(f"('{d}', '{'blank' if d == 'space' else s}')" for d, s in DIALECTS.items())
    breaks = scenarios.SCENARIOS["checks_breaks"]
    off = scenarios._NO_BREAKS + scenarios._NO_BIRTHS + ("parent_child_count", "sex_role_ambiguity", "sex_role_override")
    verified = ", ".join(f"('{c.name}', {str(c.name in off).lower()})" for c in validation.CHECKS)
    return {
        "read_dialects": f"WITH{ped}{PARTIAL} SELECT d.dialect, row_number() OVER (PARTITION BY d.dialect ORDER BY id) - 1 AS row, (id + 1)::VARCHAR AS id, sex, "
            f"coalesce((mother + 1)::VARCHAR, '-1') AS mother, coalesce((father + 1)::VARCHAR, '-1') AS father FROM part, (VALUES {dialects}) d(dialect)",
        "command_exit_codes": "SELECT command, \"case\", code, files FROM (VALUES " + ", ".join(f"('{c}', '{(t + ' ' + o).strip()}', {n}, '{f}')" for c, t, o, n, f in COMMANDS) + ") t(command, \"case\", code, files)",
        "sniffed_delimiters": f"SELECT * FROM (VALUES {names}) t(dialect, delimiter)",
        "aligned_column_read": f"WITH{ped}{_PERSON} SELECT p.id, two.flag FROM ped p LEFT JOIN two USING (id)",
        "reference_mask_read": f"WITH{ped}{_PERSON} SELECT p.id, coalesce(two.flag = 'Yes', false) AS reference FROM ped p LEFT JOIN two USING (id)",
        "trait_token_read": f"WITH{ped}{_PERSON} SELECT p.id, two.trait FROM ped p LEFT JOIN two USING (id)",
        "fixed_pedigree_file": f"SELECT id, CASE sex WHEN 'M' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS sex, coalesce(mother, -1) AS mother, coalesce(father, -1) AS father, "
            f"sex_source FROM ({fixed})",
        "verified_pedigree": f"SELECT name AS \"check\", CASE WHEN off THEN 'SKIP' ELSE 'PASS' END AS status, 0::BIGINT AS n, 0::BIGINT AS n_refs FROM (VALUES {verified}) "
            f"v(name, off)",
        "annotated_file": f"WITH{ped}{PARTIAL} SELECT id, sex, coalesce(sex, 'U') AS sex_input, segment, (SELECT count(*) FROM part c WHERE c.mother = p.id OR c.father "
            f"= p.id) AS n_offspring, mother IS NULL AND father IS NULL AS is_founder FROM part p",
        "long_report_file": f"WITH RECURSIVE{ped}, walks AS (SELECT id, id AS anc, 0 AS gen FROM ped UNION SELECT w.id, e.parent, w.gen + 1 FROM walks w JOIN edges e ON "
            f"e.child = w.anc), d AS (SELECT id, max(gen) AS depth FROM walks GROUP BY id), dn AS (SELECT depth, count(*) AS n FROM d GROUP BY 1) SELECT "
            f"'structure.sex' AS section, sex AS key, '' AS subkey, count(*)::VARCHAR AS value FROM ped GROUP BY sex UNION ALL SELECT "
            f"'structure.depth_n', depth::VARCHAR, '', n::VARCHAR FROM dn UNION ALL SELECT 'strata.by', depth::VARCHAR, 'n', n::VARCHAR FROM dn",
        "validation_log_file": f'SELECT "check", n FROM ({log}) WHERE n > 0',
        "cleared_links": f"WITH RECURSIVE{ped},\n{scenarios._typed(breaks)}{scenarios._cleared(breaks)} SELECT id, role, parent, 'cycle' AS reason FROM late UNION ALL "
            f"SELECT w.id, w.role, CASE w.role WHEN 'mother' THEN s.mother ELSE s.father END, 'role' FROM wrong w JOIN src2 s USING (id)",
    }
