"""Sources, sinks, checks, repairs and commands on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from kinfold import cli
from kinfold.functions import tokens as T
from kinfold.plans import fixing, reports
from kinfold.plans.validation import CHECKS, Options, validate
from kinfold.sources import sinks
from kinfold.sources.delimited import SourceError, header, number_rows, read_table, reference_mask, sniff

CLEAN = "id\tsex\tmother\tfather\tbirth_year\n1\tM\t-1\t-1\t1950\n2\tF\t-1\t-1\t1951\n3\tM\t2\t1\t1980\n4\tF\t2\t1\t1982\n"


@pytest.fixture
def table(spark, tmp_path):
    def make(text, name="in.tsv"):
        p = tmp_path / name
        p.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
        return str(p)

    return make


def test_sniff():
    assert [sniff(x) for x in ("a\tb,c\td", "a,b", "a;b;c,d", "a|b", "a b", "a")] == ["\t", ",", ";", "|", None, "\t"]


def test_read(spark, table):
    got = read_table(spark, table("\n" + CLEAN.replace("1951", "NA"), "x.tsv.gz")).orderBy("row").collect()
    assert [r["row"] for r in got] == [0, 1, 2, 3] and got[1]["birth_year"] is None and got[2]["mother"] == "2"
    assert read_table(spark, table('id,name\n1,"a, b"\n')).first()["name"] == "a, b"
    assert [r["b"] for r in read_table(spark, table("a   b\n1  2\n 3\t4 \n")).orderBy("row").collect()] == ["2", "4"]
    assert header(spark, table(CLEAN)) == ["id", "sex", "mother", "father", "birth_year"]
    assert read_table(spark, table(CLEAN), columns=["sex"]).columns == ["row", "sex"]
    for bad in ("", "a b\n1 2 3\n", "a\ta\n1\t2\n"):
        with pytest.raises(SourceError):
            read_table(spark, table(bad))
    with pytest.raises(SourceError):
        read_table(spark, table("a,b\n1,2\n"), sep="\t")


def test_row_numbers_over_many_partitions(spark):
    df = number_rows(spark.range(0, 5000, 1, 7).withColumnRenamed("id", "value"))
    assert df.where("row != value").count() == 0 and df.count() == 5000


def test_tokens(spark):
    df = spark.createDataFrame([("F ",), ("male",), ("2",), ("0",), (" u",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(T.sex("t")).collect()] == ["F", "M", "F", None, None, "!", None]
    df = spark.createDataFrame([("1",), ("001",), ("+5",), ("-3",), ("9223372036854775808",), (" 7",)], "t string")
    assert [r[0] for r in df.select(T.is_plain_integer("t")).collect()] == [True, False, False, True, False, False]
    df = spark.createDataFrame([("1980.7",), ("-1",), ("-5",), ("inf",), ("x",), ("NA",)], "t string")
    year, bad = T.birth_year("t")
    assert [tuple(r) for r in df.select(year, bad).collect()] == [(1980, False), (None, False), (None, True), (None, True), (None, True), (None, False)]
    df = spark.createDataFrame([("2000-02-29",), ("2001-02-29",), ("2000-2-1",), (".",)], "t string")
    day, bad = T.birth_date("t")
    assert [r[1] for r in df.select(day, bad).collect()] == [False, True, True, False]
    age = spark.sql("SELECT date'2000-02-29' AS s, date'2021-02-28' AS e").select(T.whole_years(F.col("s"), F.col("e"))).first()[0]
    assert age == 20


def test_reference_mask(spark, table):
    t = read_table(spark, table("id\tref\n1\tyes\n2\t\n3\tF\n"))
    ids = spark.range(1, 5)
    assert {r["id"]: r["reference"] for r in reference_mask(ids, t, "id", "ref").collect()} == {1: True, 2: False, 3: False, 4: False}
    with pytest.raises(T.TokenError):
        reference_mask(ids, read_table(spark, table("id\tref\n1\tmaybe\n")), "id", "ref")


def checked(spark, table, text, **options):
    return validate(read_table(spark, table(text)), Options(**options))


HEAD = "id\tsex\tmother\tfather\tbirth_year\n1\tM\t-1\t-1\t1950\n2\tF\t-1\t-1\t1951\n"


@pytest.mark.parametrize(
    ("name", "rows", "options"),
    [
        ("required_columns", None, {"sex": "gender"}),
        ("id_dtype", "\tM\t2\t1\t1980\n", {}),
        ("sex_tokens", "3\tQ\t2\t1\t1980\n", {}),
        ("birth_year_dtype", "3\tM\t2\t1\tx\n", {"birth_year": "birth_year"}),
        ("duplicate_rows", "2\tF\t-1\t-1\t1951\n", {}),
        ("negative_ids", "-7\tF\t2\t1\t1951\n", {}),
        ("duplicate_ids", "2\tM\t-1\t-1\t1951\n", {}),
        ("parent_token_range_mother", "3\tM\t-9\t1\t1980\n", {}),
        ("zero_parent_present", "3\tM\t0\t1\t1980\n", {}),
        ("parent_refs_present_father", "3\tM\t2\t99\t1980\n", {}),
        ("parent_child_count", "3\tM\t2\t1\t1980\n4\tM\t2\t1\t1980\n", {"max_children_mother": 1}),
        ("parent_refs_sex_conflict", "3\tM\t9\t1\t1980\n4\tM\t2\t9\t1980\n", {}),
        ("sex_role_ambiguity", "5\tU\t-1\t-1\t\n3\tM\t5\t1\t1980\n4\tM\t2\t5\t1980\n", {}),
        ("parent_role_conflict", "5\tM\t-1\t-1\t\n3\tM\t5\t1\t1980\n4\tM\t2\t5\t1980\n", {}),
        ("self_loops", "3\tM\t2\t3\t1980\n", {}),
        ("parents_distinct", "3\tM\t2\t2\t1980\n", {}),
        ("sex_role_override", "3\tM\t1\t-1\t1980\n", {}),
        ("sex_role_consistency", "3\tM\t1\t-1\t1980\n", {"override_asserted_sex": False}),
        ("acyclic", "3\tF\t4\t1\t1980\n4\tF\t3\t1\t1980\n", {}),
        ("birth_year_range", "3\tM\t2\t1\t1700\n", {"birth_year": "birth_year"}),
        ("birth_year_topology", "3\tM\t2\t1\t1940\n", {"birth_year": "birth_year"}),
        ("cycle_breaks", "3\tF\t4\t1\t1980\n4\tF\t3\t1\t1990\n", {"break_cycles": True, "birth_year": "birth_year"}),
        ("role_conflict_breaks", "5\tM\t-1\t-1\t\n3\tM\t5\t1\t1980\n4\tM\t2\t5\t1980\n", {"break_role_conflicts": True}),
    ],
)
def test_each_check_fails_where_it_should(spark, table, name, rows, options):
    got = checked(spark, table, HEAD + (rows or ""), **options)
    assert got.status[name] == "FAIL", got.summary()
    assert got.findings.where(F.col("check") == name).count() >= 1


def test_clean_tables_pass(spark, table):
    got = checked(spark, table, CLEAN, birth_year="birth_year")
    assert "FAIL" not in got.status.values() and len(got.status) == len(CHECKS) == 33 and fixing.exit_code(got) == 0
    assert checked(spark, table, HEAD.split("\n")[0] + "\n").status["empty_pedigree"] == "FAIL"


def test_dates_and_twins(spark, table):
    text = "id\tsex\tmother\tfather\tborn\tset\tzyg\n1\tM\t\t\t1950-01-01\t\t\n2\tF\t\t\t1951-01-01\t\t\n3\tM\t2\t1\t1980-05-01\ta\tMZ\n4\tM\t2\t1\t1980-05-02\ta\tMZ\n5\tF\t2\t1\t1949-01-01\tb\tDZ\n6\tF\t2\t1\t1985-01-01\tc\tMZ\n7\tM\t2\t1\t1985-01-20\tc\tMZ\n"
    got = checked(spark, table, text, birth_date="born", multiple_birth="set", zygosity="zyg")
    assert [got.status[c] for c in ("birth_date_dtype", "birth_date_topology", "multiple_birth_sets", "mz_links")] == ["PASS", "FAIL", "FAIL", "FAIL"]
    assert {r["id"]: r["co_twin"] for r in got.context.ped.where("co_twin is not null").collect()} == {3: 4, 4: 3}
    assert {(r["id"], r["detail"]) for r in got.findings.where("check = 'multiple_birth_sets'").collect()} == {("5", "set b: single"), ("6", "set c: dates apart"), ("7", "set c: dates apart")}


def test_string_ids(spark, table):
    got = checked(spark, table, "id\tsex\tmother\tfather\n001\tM\t.\tNA\n1\tF\t-1\t\nx\tM\t1\t001\n")
    assert not got.context.integer and got.context.ped.where("id = 'x' and father = '001'").count() == 1


def test_reduction(spark, table):
    text = HEAD + "3\tM\t2\t1\t1980\n3\tF\t2\t1\t1981\n4\tM\t4\t1\t1980\n6\tF\t7\t1\t1980\n7\tF\t6\t1\t1980\n8\tF\t7\t1\t1999\n"
    r = fixing.reduce_pedigree(read_table(spark, table(text)), Options(birth_year="birth_year"))
    dropped = {(x["id"], x["check"]) for x in r.dropped.collect()}
    assert ("3", "duplicate_ids") in dropped and ("6", "acyclic") in dropped and "8" not in {d[0] for d in dropped}
    assert not r.report.failed("block", "block_or_drop", "keep_or_drop")
    assert fixing.exit_code(r.report, r.dropped) == 1


def test_fix(spark, table):
    report = checked(spark, table, HEAD + "3\tU\t9\t-1\t1980\n4\tM\t3\t1\t2001\n")
    got = {r["id"]: r for r in fixing.fix(report, fill_half_founders=True).collect()}
    assert got[9]["sex"] == "F" and got[9]["ped_depth"] == 0 and got[3]["sex"] == "F" and got[3]["sex_source"] == "imputed_from_missing"
    assert got[3]["father"] == 10 and got[10]["sex"] == "M" and got[4]["ped_depth"] == 2


def test_yaml_and_rounding():
    assert sinks.yaml({"a": {"b": 1.5, "c": None, "d": [1, "x: y"]}, "e": {}}) == "a:\n  b: 1.5\n  c: null\n  d:\n    - 1\n    - 'x: y'\ne: {}\n"
    assert sinks.rounded({"x": 0.00123456}, significant=True) == {"x": 0.001235} and sinks.rounded(1.23456) == 1.2346
    assert list(sinks.flatten({"s": {"k": {"q": 2.0}, "v": 1}})) == [("s.k", "q", "", "2.0")] or list(sinks.flatten({"s": {"k": 2.0}})) == [("s", "k", "", "2.0")]


def test_out_dir(tmp_path):
    (tmp_path / "f").write_text("x")
    with pytest.raises(NotADirectoryError):
        sinks.prepare_out_dir(tmp_path / "f")
    with pytest.raises(FileExistsError):
        sinks.prepare_out_dir(tmp_path, safe=True)


def test_commands(spark, table, tmp_path):
    path = table(CLEAN.replace("birth_year", "birth_year\tx").replace("1950", "1950\t1.5").replace("1951", "1951\t2").replace("1980", "1980\t3").replace("1982", "1982\t4"))
    for command, extra, files in (("summarize", ["--sex-concordance", "--tsv", "--birth-year-col", "birth_year"], ["summarize.yaml", "annotated.tsv", "summary.tsv"]), ("validate", [], ["validate.log", "validate.tsv"]), ("effective-size", ["--estimators", "ne_sex_ratio,ne_inbreeding"], ["effective-size.yaml"]), ("relatives-input", ["--pairs", "--parquet"], ["skeleton.tsv", "pairs.parquet"])):
        out = tmp_path / command
        assert cli.run([command, "--in", path, "--out", str(out), *extra]) == 0, command
        assert all((out / f).exists() for f in files)
    blocked = table(HEAD + "3\tM\t2\t2\t1980\n", "bad.tsv")
    assert cli.run(["summarize", "--in", blocked, "--out", str(tmp_path / "b")]) == 2
    with pytest.raises(SystemExit):
        cli.run(["summarize", "--in", path, "--out", str(tmp_path / "s"), "--safe-attempt", "--tsv"])


def test_summary_report(spark, table):
    got = reports.summarize(read_table(spark, table(CLEAN)), Options())
    assert got.payload["structure"]["size_structure"]["n_individuals"] == 4 and got.payload["relatedness"]["relationship_pairs"]["FS"] == 1
    safe = reports.safe_summary(read_table(spark, table(CLEAN)), Options())
    assert safe.payload["release"]["individuals"] is None


@pytest.mark.parametrize(
    "argv",
    [
        ["summarize", "--min-parent-age", "30", "--max-parent-age", "20"],
        ["summarize", "--zygosity-col", "z"],
        ["summarize", "--id-log"],
        ["summarize", "--per-individual-burden", "--max-degree", "3"],
        ["summarize", "--safe-attempt", "--min-cell", "2"],
        ["validate", "--break-cycles"],
        ["validate", "--twin-max-days", "3"],
        ["validate", "--twin-max-days", "3", "--birth-date-col", "d", "--multiple-birth-col", "m"],
        ["validate", "--twin-max-days", "30", "--birth-date-col", "d"],
        ["effective-size", "--estimators", "ne_nothing"],
        ["assortative-mating", "--trait", "a", "b", "c"],
        ["assortative-mating", "--trait", "a", "a"],
        ["assortative-mating", "--trait", "a", "--trait-type", "b=ordinal"],
        ["assortative-mating", "--trait", "a", "--trait-type", "a=ordinal", "a=binary"],
        ["assortative-mating", "--trait", "a", "--stratify-by", "birth_year"],
    ],
)
def test_usage_errors(tmp_path, argv):
    with pytest.raises(SystemExit) as e:
        cli.run([argv[0], "--in", "none.tsv", "--out", str(tmp_path / "out"), *argv[1:]])
    assert e.value.code == 2 and not (tmp_path / "out").exists()


def test_safe_commands(spark, table, tmp_path):
    """Small pedigrees release nothing; nothing of the ordinary report is written; a second run takes its own folder."""
    path = table(CLEAN.replace("birth_year", "birth_year\tx").replace("1950", "1950\t1.5").replace("1951", "1951\t2").replace("1980", "1980\t3").replace("1982", "1982\t4"))
    for command, extra in (("effective-size", ["--birth-year-col", "birth_year"]), ("assortative-mating", ["--trait", "x", "--trait-type", "x=continuous"])):
        out = tmp_path / command
        for _ in range(2):
            assert cli.run([command, "--in", path, "--out", str(out), "--safe-attempt", "--id-log", *extra]) == 0
        text = (out / f"{command}.yaml").read_text()
        assert "withheld" in text and not [x for x in ("slope: 0", "n_networks", "sum_c2", "max_delta") if x in text]
        assert "1, " not in (out / f"{command}.log").read_text() and "example" in (out / f"{command}.ids.local.log").read_text()
    (out / "other.txt").write_text("x")
    with pytest.raises(FileExistsError):
        cli.run([command, "--in", path, "--out", str(out), "--safe-attempt", *extra])


def test_stale_outputs_go(spark, table, tmp_path):
    out = tmp_path / "v"
    assert cli.run(["validate", "--in", table(CLEAN), "--out", str(out)]) == 0 and (out / "validate.tsv").exists()
    assert cli.run(["validate", "--in", table(HEAD + "3\tM\t2\t2\t1980\n", "bad.tsv"), "--out", str(out)]) == 2
    assert not (out / "validate.tsv").exists() and (out / "validate.log").exists()
