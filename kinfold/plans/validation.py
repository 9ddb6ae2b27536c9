"""Validation: 33 checks in registry order, repairs, sex imputation.

A check's findings are rows (check, id, row, detail, n_refs); a check fails if it has any, and is skipped if it isn't asked
for or a check it needs didn't pass.  Three checks change the pedigree for those after them, so the work is cut into a few
*passes* at these places.  A pass is one job: it collects the findings of all its checks in an array beside the row and
counts them while the rows are written.

1. tokens: what the columns hold;  2. rows: copies, ids;  3. (if asked for) cleared links;  4. persons: all that follows from
a person's row and its roles as a parent;  5. links with births;  6. depth;  7. recorded sets;  8. their linked pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import tokens as T
from kinfold.operators.graph import cycle_components, structural_depth
from kinfold.session import counted, stored

FINDING = "check string, id string, row long, detail string, n_refs long"


@dataclass(frozen=True)
class Options:
    id: str = "id"
    sex: str = "sex"
    mother: str = "mother"
    father: str = "father"
    birth_year: str | None = None
    birth_date: str | None = None
    multiple_birth: str | None = None
    zygosity: str | None = None
    missing_parent: tuple[str, ...] = ()
    birth_year_min: int = 1800
    birth_year_max: int = field(default_factory=lambda: date.today().year + 1)
    min_parent_age: int = 0
    max_parent_age: int = 0  # 0: no limit
    max_children_mother: int | None = None
    max_children_father: int | None = None
    twin_max_days: int = 7
    allow_missing_sex: bool = False
    override_asserted_sex: bool = True
    sex_check: bool = True
    break_cycles: bool = False
    break_role_conflicts: bool = False


class Check(NamedTuple):
    name: str
    policy: str
    needs: tuple[str, ...]


_IDS = ("id_dtype", "negative_ids", "duplicate_ids")
_COLS = ("required_columns",)
_SEXED = (*_IDS, "sex_tokens")

# The checks' names, policies and prerequisites, in registry order.
CHECKS = (
    Check("required_columns", "block", ()),
    Check("empty_pedigree", "block", _COLS),
    Check("id_dtype", "block", _COLS),
    Check("sex_tokens", "block", _COLS),
    Check("birth_year_dtype", "block", _COLS),
    Check("birth_date_dtype", "block", _COLS),
    Check("zygosity_tokens", "block", _COLS),
    Check("duplicate_rows", "autofix", ("id_dtype", "sex_tokens")),
    Check("negative_ids", "block", ("id_dtype",)),
    Check("duplicate_ids", "block_or_drop", ("id_dtype",)),
    Check("parent_token_range_mother", "block", ("id_dtype",)),
    Check("parent_token_range_father", "block", ("id_dtype",)),
    Check("zero_parent_present", "block", _IDS),
    Check("cycle_breaks", "autofix", _IDS),
    Check("role_conflict_breaks", "autofix", _SEXED),
    Check("parent_refs_present_mother", "autofix", _IDS),
    Check("parent_refs_present_father", "autofix", _IDS),
    Check("parent_child_count", "keep_or_drop", _IDS),
    Check("parent_refs_sex_conflict", "block_or_drop", _IDS),
    Check("sex_role_ambiguity", "block_or_drop", _SEXED),
    Check("parent_role_conflict", "block_or_drop", _SEXED),
    Check("self_loops", "keep_or_drop", _IDS),
    Check("parents_distinct", "block_or_drop", _IDS),
    Check("sex_role_override", "autofix", _SEXED),
    Check("sex_role_consistency", "keep_or_drop", _SEXED),
    Check("acyclic", "block_or_drop", (*_IDS, "parents_distinct")),
    Check("birth_year_range", "keep_or_drop", ("id_dtype", "birth_year_dtype")),
    Check("birth_year_topology", "keep_or_drop", (*_IDS, "birth_year_dtype")),
    Check("birth_date_range", "keep_or_drop", ("id_dtype", "birth_date_dtype")),
    Check("birth_date_year_consistency", "keep_or_drop", ("id_dtype", "birth_date_dtype", "birth_year_dtype")),
    Check("birth_date_topology", "keep_or_drop", (*_IDS, "birth_date_dtype")),
    Check("multiple_birth_sets", "autofix", _IDS),
    Check("mz_links", "autofix", (*_IDS, "zygosity_tokens")),
)


@dataclass
class Context:
    """``ped``: row, id, sex, sex_source, mother, father, birth_year, birth_date, zygosity, set, co_twin."""

    raw: DataFrame
    options: Options
    ped: DataFrame | None = None
    integer: bool = True
    depth: DataFrame | None = None
    cleared: DataFrame | None = None
    status: dict[str, str] = field(default_factory=dict)
    found: list[DataFrame] = field(default_factory=list)

    def keep(self, ped: DataFrame) -> None:
        self.ped = ped
        self.depth = None

    def depths(self) -> DataFrame:
        if self.depth is None:
            self.depth = stored(structural_depth(self.ped), "depth")
        return self.depth

    def due(self, *names: str) -> list[str]:
        """Of these checks the ones whose prerequisites passed; the others are skipped."""
        out = []
        for name in names:
            ready = all(self.status.get(n) == "PASS" for n in NEEDS[name])
            self.status[name] = "PASS" if ready else "SKIP"
            out += [name] if ready else []
        return out

    def skip(self, *names: str) -> None:
        self.status |= dict.fromkeys(names, "SKIP")

    def record(self, name: str, n: int | None, findings: DataFrame | None = None) -> None:
        self.status[name] = "FAIL" if n else "PASS"
        if n and findings is not None:
            self.found.append(findings)


class Finding(NamedTuple):
    """What a check finds on a row: where ``when`` holds, ``id``, ``row``, ``detail`` and ``n_refs``."""

    check: str
    when: Column
    id: Column
    row: Column
    detail: Column | None = None
    n_refs: Column | None = None


def _struct(f: Finding) -> Column:
    text = F.lit("") if f.detail is None else f.detail
    return F.struct(F.lit(f.check).alias("check"), f.id.cast("string").alias("id"), f.row.cast("long").alias("row"), text.cast("string").alias("detail"), (F.lit(None) if f.n_refs is None else f.n_refs).cast("long").alias("n_refs"))


def _pass(c: Context, df: DataFrame, name: str, wanted: list[Finding], **totals: Column) -> tuple[DataFrame, dict]:
    """Write ``df``, note the findings of several checks and count them, in one job."""
    if not wanted:
        return counted(df, name, **totals)
    hits = F.filter(F.array(*(F.when(F.coalesce(f.when, F.lit(False)), _struct(f)) for f in wanted)), lambda x: x.isNotNull())
    sums: dict[str, Column] = {}
    for f in wanted:
        own = F.count_if(F.coalesce(f.when, F.lit(False)))
        sums[f"c_{f.check}"] = sums[f"c_{f.check}"] + own if f"c_{f.check}" in sums else own
    table, seen = counted(df.withColumn("_found", hits), name, **totals, **sums)
    findings = table.where(F.size("_found") > 0).select(F.explode("_found").alias("f")).select("f.*")
    for check in dict.fromkeys(f.check for f in wanted):
        c.record(check, seen[f"c_{check}"])
    if any(seen[f"c_{f.check}"] for f in wanted):
        c.found.append(findings)
    return table.drop("_found"), seen


def parse(raw: DataFrame, o: Options, *extra: Column) -> tuple[DataFrame, bool]:
    """The typed pedigree, and whether ids are integers: all tokens must print back exactly, else all are text."""
    ident = T.strip(o.id)
    parents = {p: T.missing_as_null(getattr(o, p), o.missing_parent) for p in ("mother", "father")}
    parents = {p: F.when(t != "-1", t) for p, t in parents.items()}
    t = raw.select("row", ident.alias("i"), *(v.alias(p) for p, v in parents.items()))
    plain = lambda c: F.col(c).isNull() | T.is_plain_integer(c)
    integer = bool(t.agg(F.coalesce(F.bool_and(plain("i") & plain("mother") & plain("father")), F.lit(True))).first()[0])
    key = (lambda c: c.cast("long")) if integer else (lambda c: c)
    have = lambda n: n is not None and n in raw.columns
    sex = T.sex(o.sex) if have(o.sex) else F.lit(None).cast("string")
    year, date_, zyg = (f(n)[0] if have(n) else F.lit(None).cast(kind) for f, n, kind in ((T.birth_year, o.birth_year, "int"), (T.birth_date, o.birth_date, "date"), (T.zygosity, o.zygosity, "string")))
    group = T.missing_as_null(o.multiple_birth) if have(o.multiple_birth) else F.lit(None).cast("string")
    ped = raw.select("row", key(ident).alias("id"), F.when(sex != "!", sex).alias("sex"), *(key(v).alias(p) for p, v in parents.items()), year.alias("birth_year"), date_.alias("birth_date"), zyg.alias("zygosity"), group.alias("set"), *extra)
    return ped, integer


def _tokens(c: Context) -> None:
    """Pass 1: the typed table, one pass over the text columns."""
    o, raw = c.options, c.raw
    c.due("id_dtype", "sex_tokens", "birth_year_dtype", "birth_date_dtype", "zygosity_tokens")
    ident, row = F.col("_id"), F.col("row")
    wanted = [Finding("id_dtype", F.col("_no_id"), ident, row, F.lit("missing id"))]
    extra = [F.col(o.id).alias("_id"), T.missing_as_null(o.id).isNull().alias("_no_id")]
    if o.missing_parent:
        extra.append(T.strip(o.id).isin(*o.missing_parent).alias("_clash"))
        wanted.append(Finding("id_dtype", F.col("_clash"), ident, row, F.lit("an id is a missing-parent token")))
    bad = {"sex_tokens": (o.sex, lambda n: T.sex(n) == "!"), "birth_year_dtype": (o.birth_year, lambda n: T.birth_year(n)[1]), "birth_date_dtype": (o.birth_date, lambda n: T.birth_date(n)[1]), "zygosity_tokens": (o.zygosity, lambda n: T.zygosity(n)[1])}
    for check, (name, test) in bad.items():
        if name is None or name not in raw.columns:
            c.skip(check)
            continue
        extra += [test(name).alias(f"_{check}"), F.col(name).alias(f"_t_{check}")]
        wanted.append(Finding(check, F.col(f"_{check}"), ident, row, F.concat(F.lit("token "), F.col(f"_t_{check}"))))
    used = {o.id, o.sex, o.mother, o.father, o.birth_year, o.birth_date, o.multiple_birth, o.zygosity, "row"}
    others = [F.col(n) for n in raw.columns if n not in used]
    extra.append(F.struct(*others).alias("_rest") if others else F.lit(0).alias("_rest"))
    ped, c.integer = parse(raw, o, *extra)
    c.keep(_pass(c, ped, "parsed", wanted)[0])


_TYPED = ("row", "id", "sex", "mother", "father", "birth_year", "birth_date", "zygosity", "set")


def _rows(c: Context) -> None:
    """Pass 2: copies of rows go; ids and parents out of range; a parent 0 without a row."""
    due = c.due("duplicate_rows", "negative_ids", "parent_token_range_mother", "parent_token_range_father")
    ped, row = c.ped, F.col("row")
    number = lambda n: F.col(n) if c.integer else F.when(T.is_plain_integer(n), F.col(n).try_cast("long"))
    first = F.lit(True)
    wanted = []
    if "duplicate_rows" in due:
        ped = ped.withColumn("first", F.min("row").over(W.partitionBy(*_TYPED[1:], "_rest")))
        first = row == F.col("first")
        wanted.append(Finding("duplicate_rows", ~first, F.col("id"), row, F.concat(F.lit("repeats row "), F.col("first"))))
    if "negative_ids" in due:
        wanted.append(Finding("negative_ids", first & (number("id") < 0), F.col("id"), row))
        wanted += [Finding(f"parent_token_range_{p}", first & (number(p) < -1), F.lit(None), row, F.col(p).cast("string")) for p in ("mother", "father")]
    zero = lambda n: first & (F.col(n).cast("string") == "0")
    sums = {"zeros": F.count_if(zero("id"))} | {f"{k}_{p}": v for p in ("mother", "father") for k, v in (("refs", F.count_if(zero(p))), ("at", F.min(F.when(zero(p), row))))}
    table, seen = _pass(c, ped.withColumn("_first", first), "rows", wanted, **sums)
    c.keep(table.where("_first").select(*_TYPED))
    if c.due("duplicate_ids"):
        twice = c.ped.groupBy("id").agg(F.count("*").alias("k")).where("k > 1")
        twice, n = counted(twice, "duplicate-ids")
        c.record("duplicate_ids", n["n"], twice.select(_struct(Finding("duplicate_ids", F.lit(True), F.col("id"), F.lit(None), F.concat(F.col("k"), F.lit(" rows differ")))).alias("f")).select("f.*"))
    if c.due("zero_parent_present"):
        gone = [] if seen["zeros"] else [("zero_parent_present", "0", seen[f"at_{p}"], f"0 is a {p} without a row", seen[f"refs_{p}"]) for p in ("mother", "father") if seen[f"refs_{p}"]]
        c.record("zero_parent_present", len(gone), c.raw.sparkSession.createDataFrame(gone, FINDING))


def parent_links(ped: DataFrame) -> DataFrame:
    """row, id, role, parent for every recorded parent."""
    return ped.select("row", "id", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("parent")) for r in ("mother", "father")))).alias("e")).select("row", "id", "e.role", "e.parent").where("parent is not null")


def absent_parents(ped: DataFrame) -> DataFrame:
    """parent, role, n_refs, first row of parents without a row."""
    links = parent_links(ped).join(ped.select(F.col("id").alias("parent")), "parent", "left_anti")
    return links.groupBy("parent", "role").agg(F.count("*").alias("n_refs"), F.min("row").alias("row"))


def roles(ped: DataFrame) -> DataFrame:
    """id, is_mother, is_father of everyone named as a parent."""
    return parent_links(ped).groupBy(F.col("parent").alias("id")).agg(F.bool_or(F.col("role") == "mother").alias("is_mother"), F.bool_or(F.col("role") == "father").alias("is_father"))


def _clear(c: Context, links: DataFrame, reason: str) -> None:
    """Remove parent links (id, role, parent)."""
    links = stored(links.select("id", "role", "parent").distinct(), "cleared")
    wide = links.groupBy("id").agg(F.bool_or(F.col("role") == "mother").alias("_m"), F.bool_or(F.col("role") == "father").alias("_f"))
    ped = c.ped.join(wide, "id", "left")
    for role, flag in (("mother", "_m"), ("father", "_f")):
        ped = ped.withColumn(role, F.when(~F.coalesce(flag, F.lit(False)), F.col(role)))
    c.keep(ped.drop("_m", "_f"))
    new = links.withColumn("reason", F.lit(reason))
    c.cleared = new if c.cleared is None else c.cleared.unionByName(new)


def sexed_in_both_roles(ped: DataFrame) -> DataFrame:
    """Rows with a recorded sex that are a mother of one row and a father of another; both parents of one row don't count."""
    return ped.where("sex is not null").join(roles(ped.where("not (mother <=> father)")).where("is_mother and is_father"), "id")


def _cycle_breaks(c: Context) -> DataFrame:
    born = c.ped.select(F.col("id").alias("parent"), F.col("birth_date").alias("pd"), F.coalesce("birth_year", F.year("birth_date")).alias("py"))
    cyc = stored(cycle_components(c.ped, c.depths()), "cycles")
    links = parent_links(c.ped).join(c.ped.select("row", "birth_date", F.coalesce("birth_year", F.year("birth_date")).alias("year")), "row")
    own = links.where("id = parent").select("row", "id", "role", "parent")
    inside = links.where("id != parent").join(cyc, "id").join(cyc.select(F.col("id").alias("parent"), F.col("cycle").alias("pc")), "parent").where("cycle = pc").join(born, "parent")
    dates = F.col("birth_date").isNotNull() & F.col("pd").isNotNull()
    late = F.when(dates, F.col("pd") > F.col("birth_date")).otherwise(F.col("py") > F.col("year"))
    cut = stored(own.unionByName(inside.where(late).select("row", "id", "role", "parent")), "cycle-breaks")
    _clear(c, cut, "cycle")
    return _finding(cut, "cycle_breaks", F.concat(F.col("role"), F.lit(" "), F.col("parent"), F.lit(" cleared")))


def _role_breaks(c: Context) -> DataFrame:
    both = sexed_in_both_roles(c.ped).select("id", "sex")
    wrong = both.select(F.col("id").alias("parent"), F.when(F.col("sex") == "F", "father").otherwise("mother").alias("role"))
    cut = stored(parent_links(c.ped.where("not (mother <=> father)")).join(wrong, ["parent", "role"]).select("row", "id", "role", "parent"), "role-breaks")
    _clear(c, cut, "role")
    return _finding(cut, "role_conflict_breaks", F.concat(F.col("role"), F.lit(" "), F.col("parent"), F.lit(" cleared")))


def _finding(df: DataFrame, check: str, detail: Column | None = None, n_refs: Column | None = None) -> DataFrame:
    row = F.col("row") if "row" in df.columns else F.lit(None)
    return df.select(_struct(Finding(check, F.lit(True), F.col("id"), row, detail, n_refs)).alias("f")).select("f.*")


def _breaks(c: Context) -> None:
    """Pass 3."""
    for check, asked, run in (("cycle_breaks", c.options.break_cycles, _cycle_breaks), ("role_conflict_breaks", c.options.break_role_conflicts, _role_breaks)):
        if not asked:
            c.skip(check)
        elif c.due(check):
            got, n = counted(run(c), "findings")
            c.record(check, n["n"], got)


def impute_sex(ped: DataFrame, override: bool = True) -> DataFrame:
    """``sex`` and ``sex_source``: an unknown sex follows a sole role, an asserted one that contradicts it is overridden."""
    out = ped.drop("sex_source").join(roles(ped), "id", "left")
    m, f = (F.coalesce(c, F.lit(False)) for c in ("is_mother", "is_father"))
    sex, source = _resolved(m, f, override)
    return out.withColumns({"sex": sex, "sex_source": source}).drop("is_mother", "is_father")


def _resolved(mother: Column, father: Column, override: bool) -> tuple[Column, Column]:
    role = F.when(mother & ~father, "F").when(father & ~mother, "M")
    wrong = F.col("sex").isNotNull() & role.isNotNull() & (F.col("sex") != role)
    source = F.when(F.col("sex").isNull() & role.isNotNull(), "imputed_from_missing").when(F.col("sex").isNull(), "unresolved")
    if override:
        return F.when(wrong, role).otherwise(F.coalesce("sex", role)), source.when(wrong, "imputed_from_role").otherwise("input")
    return F.coalesce("sex", role), source.otherwise("input")


def persons(ped: DataFrame) -> DataFrame:
    """Everyone with a row or named as a parent: the row, references as mother and father with the first row of each,
    and whether there are such references by rows that don't name one person twice."""
    links = ped.select("row", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("id"), F.coalesce(F.col("mother") != F.col("father"), F.lit(True)).alias("apart")) for r in ("mother", "father")))).alias("e")).select("row", "e.*").where("id is not null")
    is_ = {"m": F.col("role") == "mother", "f": F.col("role") == "father"}
    named = links.groupBy("id").agg(*(x for k, v in is_.items() for x in (F.count_if(v).alias(f"refs_{k}"), F.min(F.when(v, F.col("row"))).alias(f"at_{k}"), F.bool_or(v & F.col("apart")).alias(f"apart_{k}"))))
    return ped.withColumn("present", F.lit(True)).join(named, "id", "full")


def _persons(c: Context) -> None:
    """Pass 4."""
    o = c.options
    here = F.coalesce("present", F.lit(False))
    refs = {k: F.coalesce(f"refs_{k}", F.lit(0)) for k in "mf"}
    both_apart = F.coalesce("apart_m", F.lit(False)) & F.coalesce("apart_f", F.lit(False))
    ident, row = F.col("id"), F.col("row")
    asked = {
        "parent_child_count": bool(o.max_children_mother or o.max_children_father), "parent_refs_sex_conflict": o.sex_check,
        "sex_role_ambiguity": not o.allow_missing_sex, "sex_role_override": o.override_asserted_sex, "birth_year_range": o.birth_year is not None,
        "birth_date_range": o.birth_date is not None, "birth_date_year_consistency": o.birth_date is not None and o.birth_year is not None,
    }
    mine = (
        "parent_refs_present_mother", "parent_refs_present_father", "parent_child_count", "parent_refs_sex_conflict", "sex_role_ambiguity", "parent_role_conflict",
        "self_loops", "parents_distinct", "sex_role_override", "sex_role_consistency", "birth_year_range", "birth_date_range", "birth_date_year_consistency",
    )
    due = c.due(*(n for n in mine if asked.get(n, True)))
    c.skip(*(n for n in mine if not asked.get(n, True)))
    if not due:
        return
    ped = persons(c.ped)
    resolves = all(c.status.get(n) == "PASS" for n in _SEXED)
    if resolves:
        sex, source = _resolved(refs["m"] > 0, refs["f"] > 0, o.override_asserted_sex)
        ped = ped.withColumns({"now": sex, "sex_source": source})
    else:
        ped = ped.withColumns({"now": F.col("sex"), "sex_source": F.lit(None).cast("string")})
    now = F.col("now")
    year = F.year("birth_date")
    known = F.col("sex_source").isin("input", "imputed_from_role") & ~(now.isNotNull() & both_apart)
    all_ = [
        *(Finding(f"parent_refs_present_{p}", ~here & (refs[p[0]] > 0), ident, F.lit(None), F.lit("a founder is added"), refs[p[0]]) for p in ("mother", "father")),
        *(Finding("parent_child_count", refs[p[0]] > F.lit(most), ident, row, F.concat(refs[p[0]], F.lit(f" children as {p}")), refs[p[0]]) for p, most in (("mother", o.max_children_mother), ("father", o.max_children_father)) if most),
        Finding("parent_refs_sex_conflict", ~here & (refs["m"] > 0) & (refs["f"] > 0), ident, F.least("at_m", "at_f"), F.lit("absent mother and father"), refs["m"] + refs["f"]),
        Finding("sex_role_ambiguity", here & F.col("sex").isNull() & (refs["m"] > 0) & (refs["f"] > 0), ident, row, F.lit("unsexed mother and father")),
        Finding("parent_role_conflict", here & F.col("sex").isNotNull() & both_apart, ident, row, F.lit("mother and father")),
        Finding("self_loops", here & ((ident == F.col("mother")) | F.coalesce(ident == F.col("father"), F.lit(False))), ident, row),
        Finding("parents_distinct", here & (F.col("mother") == F.col("father")), ident, row, F.concat(F.lit("both parents are "), F.col("mother"))),
        Finding("sex_role_override", here & (F.col("sex_source") == "imputed_from_role"), ident, row, F.concat(F.col("sex"), F.lit(" to "), now)),
        Finding("sex_role_consistency", here & known & (((refs["m"] > 0) & (now != "F")) | ((refs["f"] > 0) & (now != "M"))), ident, row),
        Finding("birth_year_range", here & ~F.col("birth_year").between(o.birth_year_min, o.birth_year_max), ident, row, F.col("birth_year").cast("string")),
        Finding("birth_date_range", here & ~year.between(o.birth_year_min, o.birth_year_max), ident, row, F.col("birth_date").cast("string")),
        Finding("birth_date_year_consistency", here & (year != F.col("birth_year")), ident, row, F.concat(F.col("birth_date"), F.lit(" and "), F.col("birth_year"))),
    ]
    table, _ = _pass(c, ped, "persons", [f for f in all_ if f.check in due])
    kept = [n for n in c.ped.columns if n != "sex"]
    c.keep(table.where("present").select(*kept, *([F.col("now").alias("sex"), "sex_source"] if resolves else ["sex"])))


def _aged_links(c: Context) -> DataFrame:
    born = c.ped.select(F.col("id").alias("parent"), F.col("birth_year").alias("py"), F.col("birth_date").alias("pd"))
    return parent_links(c.ped).join(c.ped.select("row", "birth_year", "birth_date"), "row").join(born, "parent")


def _too_old(age: Column, limit: int, slack: int) -> Column:
    """A difference of years overstates an age by up to one, hence the slack."""
    return age > limit + slack if limit else F.lit(False)


def _births(c: Context) -> None:
    """Pass 5: parents' ages, by dates where both are known, else by years."""
    o = c.options
    asked = {"birth_year_topology": o.birth_year is not None, "birth_date_topology": o.birth_date is not None}
    c.skip(*(n for n, a in asked.items() if not a))
    due = c.due(*(n for n, a in asked.items() if a))
    if not due:
        return
    links = _aged_links(c)
    dated = F.col("birth_date").isNotNull() & F.col("pd").isNotNull()
    by_year = F.coalesce("birth_year", F.year("birth_date")) - F.coalesce("py", F.year("pd"))
    by_date = T.whole_years(F.col("pd"), F.col("birth_date"))
    ident, row = F.col("id"), F.col("row")
    told = lambda age: F.concat(F.col("role"), F.lit(" "), F.col("parent"), F.lit(" aged "), age)
    all_ = [
        Finding("birth_year_topology", ~dated & ((by_year < o.min_parent_age) | _too_old(by_year, o.max_parent_age, 1)), ident, row, told(by_year)),
        Finding("birth_date_topology", dated & ((by_date < o.min_parent_age) | _too_old(by_date, o.max_parent_age, 0)), ident, row, told(by_date)),
    ]
    wanted = [f for f in all_ if f.check in due]
    some = reduce(lambda a, b: a | b, (F.coalesce(f.when, F.lit(False)) for f in wanted))
    _pass(c, links.where(some), "aged-links", wanted)


def _acyclic(c: Context) -> None:
    """Pass 6."""
    if c.due("acyclic"):
        open_ = c.ped.join(c.depths().where("depth is null").select("id"), "id")
        got, n = counted(_finding(open_, "acyclic", F.lit("in or below a cycle")), "findings")
        c.record("acyclic", n["n"], got)


def _sets(c: Context) -> None:
    """Pass 7: recorded sets that can't be sets are cleared, for the first reason that holds."""
    if c.options.multiple_birth is None:
        c.skip("multiple_birth_sets")
        return
    if not c.due("multiple_birth_sets"):
        return
    w = W.partitionBy("set")
    rows = c.ped.where("set is not null").withColumn("year", F.coalesce("birth_year", F.year("birth_date")))
    rows = rows.withColumn("gap", F.datediff("birth_date", F.lag("birth_date").over(w.orderBy("birth_date"))))
    sets = rows.groupBy("set").agg(
        F.count("*").alias("k"), F.max("gap").alias("gap"), F.count_if(F.col("mother").isNull() & F.col("father").isNull()).alias("orphans"),
        F.countDistinct("mother").alias("ms"), F.countDistinct("father").alias("fs"), F.count("birth_date").alias("dates"), F.countDistinct("year").alias("years"),
    )
    reason = (
        F.when(F.col("k") < 2, "single").when((F.col("ms") > 1) | (F.col("fs") > 1), "different parents")
        .when((F.col("orphans") > 0) & (F.col("orphans") < F.col("k")), "parents missing").when(F.col("gap") > c.options.twin_max_days, "dates apart")
        .when((F.col("dates") < F.col("k")) & (F.col("years") > 1), "years apart")
    )
    bad = sets.select("set", reason.alias("reason")).where("reason is not null")
    whole = c.ped.join(bad, "set", "left")
    wanted = [Finding("multiple_birth_sets", F.col("reason").isNotNull(), F.col("id"), F.col("row"), F.concat(F.lit("set "), F.col("set"), F.lit(": "), F.col("reason")))]
    table, _ = _pass(c, whole, "sets", wanted)
    depth = c.depth
    c.keep(table.withColumn("set", F.when(F.col("reason").isNull(), F.col("set"))).drop("reason"))
    c.depth = depth


def _links(c: Context) -> None:
    """Pass 8: marks that can't be links are reported; two marked members of one set become each other's co_twin."""
    if c.options.zygosity is None:
        c.skip("mz_links")
        return
    if not c.due("mz_links"):
        return
    marked = F.col("zygosity") == "MZ"
    sets = c.ped.where(marked).where("set is not null").groupBy("set").agg(F.count("*").alias("k"), F.countDistinct("sex").alias("sexes"), F.min("id").alias("a"), F.max("id").alias("b"))
    reason = F.when(F.col("set").isNull(), "outside a set").when(F.col("k") == 1, "only one").when(F.col("k") > 2, "three or more").when(F.col("sexes") > 1, "opposite sexes")
    rows = c.ped.join(sets, "set", "left").withColumn("reason", F.when(marked, reason))
    good = marked & F.col("reason").isNull()
    rows = rows.withColumn("co_twin", F.when(good, F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a"))))
    table, _ = _pass(c, rows, "linked", [Finding("mz_links", F.col("reason").isNotNull(), F.col("id"), F.col("row"), F.col("reason"))])
    depth = c.depth
    c.keep(table.drop("k", "sexes", "a", "b", "reason"))
    c.depth = depth


POLICY = {c.name: c.policy for c in CHECKS}
NEEDS = {c.name: c.needs for c in CHECKS}


@dataclass
class Report:
    status: dict[str, str]
    findings: DataFrame
    context: Context

    def failed(self, *policies: str) -> list[str]:
        return [n for n, s in self.status.items() if s == "FAIL" and POLICY[n] in policies]

    def summary(self) -> str:
        return "\n".join(f"{s:4} {n}" for n, s in self.status.items())


def validate(raw: DataFrame, options: Options | None = None) -> Report:
    """Run all checks; ``raw`` has text columns and ``row``."""
    c, o = Context(raw, options or Options()), options or Options()
    table = lambda rows: raw.sparkSession.createDataFrame(rows, FINDING)
    want = [o.id, o.mother, o.father, *([] if o.allow_missing_sex and o.sex not in raw.columns else [o.sex]), *(x for x in (o.birth_year, o.birth_date, o.multiple_birth, o.zygosity) if x)]
    gone = [("required_columns", None, None, f"column {n} is absent", None) for n in want if n not in raw.columns]
    c.record("required_columns", len(gone), table(gone))
    if not gone:
        if c.due("empty_pedigree") and raw.isEmpty():
            c.record("empty_pedigree", 1, table([("empty_pedigree", None, None, "no rows", None)]))
        for step in (_tokens, _rows, _breaks, _persons, _births, _acyclic, _sets, _links):
            step(c)
    status = {k.name: c.status.get(k.name, "SKIP") for k in CHECKS}
    return Report(status, reduce(DataFrame.unionByName, c.found) if c.found else table([]), c)


def with_options(o: Options, **changes) -> Options:
    return replace(o, **changes)
