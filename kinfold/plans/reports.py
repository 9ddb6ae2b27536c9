"""The five commands as functions over DataFrames: each returns a nested report and the tables to write."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import ancestry, births, concordance, disclosure, effective_size, mates, relatives, relationships, safe_mates, safe_size, sections
from kinfold.operators.families import Families
from kinfold.operators.graph import closure, pedigree_components, structural_depth
from kinfold.operators.individual import individual_table, mating_pairs
from kinfold.plans import fixing, validation
from kinfold.session import stored
from kinfold.sources.delimited import read_aligned, reference_mask, trait_tokens


@dataclass
class Result:
    payload: dict[str, Any]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    code: int = 0


class Unsupported(ValueError):
    """Options that don't go together here; a usage error."""


class Blocked(ValueError):
    """The input can't be analysed; the message names the checks that failed."""


def row(df: DataFrame) -> dict[str, Any]:
    """A table of one row as a dict."""
    r = df.first()
    return r.asDict() if r else {}


def keyed(df: DataFrame, key: str) -> dict[str, dict[str, Any]]:
    """A small table as a dict of dicts."""
    return {str(r[key]): {k: v for k, v in r.asDict().items() if k != key} for r in df.orderBy(key).collect()}


class Pedigree:
    """A valid pedigree with what the commands derive from it, each once."""

    def __init__(self, raw: DataFrame, options: validation.Options) -> None:
        self.raw, self.options = raw, options
        self.report = validation.validate(raw, options)
        if bad := self.report.failed("block", "block_or_drop"):
            raise Blocked(", ".join(bad))
        gone = validation.absent_parents(self.report.context.ped).select("parent").distinct()
        ped = self.report.context.ped
        for p in ("mother", "father"):  # a parent without a row counts as unknown
            ped = ped.join(gone.select(F.col("parent").alias(p), F.lit(True).alias(f"_{p}")), p, "left").withColumn(p, F.when(F.col(f"_{p}").isNull(), F.col(p))).drop(f"_{p}")
        self.ped = stored(ped, "pedigree")
        self._made: dict[str, DataFrame] = {}
        self._families: Families | None = None

    def once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = stored(make(), name)
        return self._made[name]

    @property
    def depth(self) -> DataFrame:
        return self.once("depth", lambda: structural_depth(self.ped))

    def paths(self, most: int | None = None) -> DataFrame:
        return self.once(f"paths-{most}", lambda: closure(self.ped, most))

    @property
    def shares(self) -> DataFrame:
        return self.once("shares", lambda: ancestry.contributions(self.paths()))

    @property
    def families(self) -> Families:
        if self._families is None:
            self._families = Families(self.ped, self.depth)
        return self._families

    @property
    def inbred(self) -> DataFrame:
        return self.families.inbred

    @property
    def twins(self) -> DataFrame | None:
        if "co_twin" not in self.ped.columns:
            return None
        return self.ped.where("co_twin is not null and id < co_twin").select(F.col("id").alias("id1"), F.col("co_twin").alias("id2"))

    def pairs(self, most: int) -> DataFrame:
        return self.once(f"pairs-{most}", lambda: relationships.relationship_pairs(self.ped, self.paths(most), most, self.twins))


def summarize(raw: DataFrame, options: validation.Options, inbreeding: bool = True, max_degree: int = 2, burden: bool = False, sex_concordance: bool = False, permutations: int = 0, seed: int = 1) -> Result:
    p = Pedigree(raw, options)
    who = p.once("individual", lambda: individual_table(p.ped, inbreeding, p.families))
    comp = p.once("components", lambda: pedigree_components(p.ped))
    structure = {"size_structure": row(sections.size_structure(p.ped, p.depth, comp)), "components": row(sections.component_summary(comp)), "max_degree_enumerated": max_degree}
    structure["size_structure"]["largest_components"] = [r["size"] for r in sections.largest_components(comp).collect()]
    demography: dict[str, Any] = {"sibship_size": row(sections.sibship_sizes(p.ped)), "mating_pairs": row(sections.mating_pair_summary(p.ped))}
    if sex_concordance:
        got = concordance.concordance(p.ped)
        if permutations:
            for g in got:
                if "p" in got[g]["input"]:
                    got[g]["input"]["p_permutation"] = concordance.permutation_p(raw.sparkSession, concordance.groups(p.ped, g), permutations, seed)
        demography["offspring_sex_concordance"] = got
    if options.multiple_birth:
        decade = p.ped.where("set is not null")
        demography["multiple_births"] = {"by_size": keyed(births.births_by_size(decade), "size"), "twins": row(births.twin_pairs_by_sex(decade)), "by_decade": keyed(births.sets_by_decade(decade), "decade"), "twins_by_decade": keyed(births.twin_pairs_by_sex(decade, True), "decade")}
    individuals = {"reproduction": keyed(sections.reproduction(who), "stratum"), "genealogy": keyed(sections.genealogy(who), "variable")}
    founders = {"founder_contribution": row(sections.founder_contribution(who)), "founder_summary": keyed(p.families.founder_summary(), "depth")}
    pairs = p.pairs(max_degree)
    relatedness: dict[str, Any] = {"relationship_pairs": relationships.relationship_counts(pairs, max_degree)}
    tables = {"individual": who}
    if burden:
        tables["burden"] = relationships.relationship_burden(p.ped, pairs, max_degree)
        relatedness["relationship_summary"] = keyed(relationships.related_density(pairs, p.depth), "depth")
    if inbreeding:
        relatedness["inbreeding"] = row(sections.inbreeding_summary(who)) | {"histogram": {r["bin"]: r["n"] for r in sections.inbreeding_histogram(who).collect()}}
    strata = {"sex_summary": keyed(sections.sex_summary(who), "sex"), "depth_summary": keyed(sections.depth_summary(who), "ped_depth")} if inbreeding else {}
    payload = {"structure": structure, "demography": demography, "individuals": individuals, "founders": founders, "relatedness": relatedness, "strata": strata, "distributions": keyed(sections.distributions(who), "variable")}
    return Result(payload, tables)


def pair_support(ped: DataFrame, pairs: DataFrame) -> DataFrame:
    """code, n, units: the families of the members, or the ancestors behind the pairs where there are fewer of them.

    The ancestors are the older members of pairs in one line and the shared parents of sibs.
    """
    family = sections.family_id(ped)
    sides = pairs.select("code", F.explode(F.array("id1", "id2")).alias("id")).join(family, "id").groupBy("code").agg((F.count("*") / 2).cast("long").alias("n"), F.countDistinct("family").alias("families"))
    line = [c for c, _, _, down, _ in relationships.CODES if not down and c != "MZ"]
    older = pairs.where(F.col("code").isin(*line)).select("code", F.col("id2").alias("anc"))
    of = pairs.where(F.col("code").isin("FS", "MHS", "PHS")).select("code", F.col("id1").alias("id")).join(ped.select("id", "mother", "father"), "id")
    shared = of.select("code", F.when(F.col("code") == "PHS", F.col("father")).otherwise(F.col("mother")).alias("anc"))
    ancestors = older.unionByName(shared).groupBy("code").agg(F.countDistinct("anc").alias("ancestors"))
    return sides.join(ancestors, "code", "left").select("code", "n", F.least("families", F.coalesce("ancestors", "families")).alias("units"))


def safe_summary(raw: DataFrame, options: validation.Options, min_cell: int = disclosure.MIN_CELL, max_degree: int = 2, inbreeding: bool = True) -> Result:
    """Only what is listed, and protected: small cells merged or withheld, counts gated by the families and ancestors behind
    them, statistics shown only beside the intact tables that they follow from."""
    p = Pedigree(raw, options)
    who = p.once("individual", lambda: individual_table(p.ped, inbreeding, p.families))

    def table(df: DataFrame, key: str) -> list[tuple[Any, int]]:
        return [(r[key], r["n"]) for r in df.groupBy(key).agg(F.count("*").alias("n")).orderBy(key).collect()]  # a row per bin

    sex = F.coalesce("sex", F.lit("unknown"))
    size = pedigree_components(p.ped).groupBy("component").agg(F.count("*").alias("size"))
    source: dict[str, Any] = {
        "individuals": p.ped.count(),
        "sex": table(p.ped.select(sex.alias("sex")), "sex"),
        "depth": table(p.depth, "depth"),
        "depth_by_sex": {(r["depth"], r["sex"]): r["n"] for r in p.ped.select("id", sex.alias("sex")).join(p.depth, "id").groupBy("depth", "sex").agg(F.count("*").alias("n")).collect()},
        "founders": p.ped.where("mother is null and father is null").count(),
        "half_founders": p.ped.where("(mother is null) != (father is null)").count(),
        "sibship_size": table(mating_pairs(p.ped), "n_offspring"),
        "offspring": table(who, "n_offspring"),
        "mates": table(who, "n_mates"),
        "component_size": table(size.select(F.pow(F.lit(10), F.floor(F.log10("size"))).cast("long").alias("from")), "from"),
        "effective_pairs": row(sections.mating_pair_summary(p.ped))["effective_pairs"],
        "mean_depth": p.depth.agg(F.avg("depth")).first()[0],
    }
    if inbreeding:
        source["inbreeding"] = [(r["bin"], r["n"]) for r in sections.inbreeding_histogram(who).orderBy("bin").collect()]
    if options.multiple_birth:
        source["multiple_births"] = [(r["size"], r["n_sets"]) for r in births.births_by_size(p.ped.where("set is not null")).orderBy("size").collect()]
    support = {r["code"]: (r["n"], r["units"]) for r in pair_support(p.ped, p.pairs(max_degree)).collect()}  # at most 23 codes
    codes = [c for c in relationships.ORDER if relationships.DEGREE[c] <= max_degree]
    source |= {f"pairs.{c}": support.get(c, (0, 0)) for c in codes}
    R = disclosure.Release  # noqa: N806
    spec = [
        R("individuals", "count"), R("sex", "unordered"), R("depth", "ordered"), R("depth_by_sex", "contingency", ("individuals",)), R("founders", "count", ("individuals",)), R("half_founders", "count", ("individuals",)),
        R("sibship_size", "ordered"), R("offspring", "ordered"), R("mates", "ordered"), R("component_size", "ordered"), *(R(f"pairs.{c}", "count", ("individuals",)) for c in codes),
        *([R("inbreeding", "ordered")] if inbreeding else []), *([R("multiple_births", "ordered")] if options.multiple_birth else []), R("effective_pairs", "derived", ("sibship_size",)), R("mean_depth", "derived", ("depth",)),
    ]
    return Result({"min_cell": min_cell, "release": disclosure.build_release(spec, source, min_cell)})


def validate(raw: DataFrame, options: validation.Options, drop_offending: bool = False, fill_half_founders: bool = False, find_twins: int | None = None) -> Result:
    if drop_offending:
        r = fixing.reduce_pedigree(raw, options)
        report, dropped = r.report, r.dropped
    else:
        report, dropped = validation.validate(raw, options), None
    code = fixing.exit_code(report, dropped)
    tables = {"findings": report.findings}
    if dropped is not None:
        tables["dropped"] = dropped
    if report.context.cleared is not None:
        tables["cleared"] = report.context.cleared
    if code != 2:
        fixed = fixing.fix(report, fill_half_founders, find_twins)
        tables["fixed"] = fixed
    return Result({"status": report.status, "summary": report.summary()}, tables, code)


def effective_sizes(raw: DataFrame, options: validation.Options, estimators: tuple[str, ...] = effective_size.ESTIMATORS, reference: str | None = None, min_cell: int | None = None) -> Result:
    """With ``min_cell``, only what the gates of each estimator let pass; long-term contributions aren't even computed then."""
    p = Pedigree(raw, options)
    if min_cell is not None:
        estimators = tuple(e for e in estimators if safe_size.RELEASES[e])
    unknown = p.ped.where("sex is null").limit(1).count() > 0
    cohorts = None
    if set(estimators) & {"inbreeding", "coancestry", "group_coancestry"}:
        cohorts = stored(p.families.by_depth(), "cohorts")
    out: dict[str, Any] = {}
    for e in estimators:
        if e in ("sex_ratio", "variance_family_size", "hill_overlapping") and unknown:
            out[e] = {"ne": None, "reason": "unknown_sex"}
        elif e in ("inbreeding", "coancestry", "group_coancestry"):
            out[e] = row(getattr(effective_size, f"ne_{e}")(cohorts))
        elif e in ("sex_ratio", "variance_family_size"):
            out[e] = row(getattr(effective_size, f"ne_{e}")(p.ped, p.depth))
        elif e == "individual_delta_f":
            people = p.families.persons
            if reference:
                people = people.join(reference_mask(p.ped.select("id"), raw, options.id, reference), "id")
            out[e] = row(effective_size.ne_individual_delta_f(people))
        elif e == "long_term_contributions":
            out[e] = row(effective_size.ne_long_term_contributions(p.ped, p.families.founder_contributions(), p.depth))
        elif e == "hill_overlapping":
            out[e] = row(effective_size.ne_hill_overlapping(p.ped)) if options.birth_year else row(effective_size.ne_variance_family_size(p.ped, p.depth))
        else:
            raise ValueError(f"no estimator {e}")
    if min_cell is None:
        return Result({"effective_size": out})
    mask = reference_mask(p.ped.select("id"), raw, options.id, reference) if reference else None
    cohorts = stored(p.families.by_depth(), "cohorts") if cohorts is None else cohorts
    table = stored(safe_size.gates(p.ped if options.birth_year else p.ped.drop("birth_year"), p.depth, p.families.persons, cohorts, p.twins, mask), "gates")
    released = safe_size.release(out, safe_size.decisions(table, min_cell))
    released["long_term_contributions"] = {"ne": None, "reason": safe_size.NOT_RELEASED}
    depth = [(int(r["cell"]), r["n"]) for r in table.where("gate = 'depth'").collect()]
    return Result({"min_cell": min_cell, "depth": {c.label: c.count for c in disclosure.protect_ordered(sorted(depth), min_cell)}, "effective_size": released})


def assortative_mating(raw: DataFrame, options: validation.Options, traits: list[str], kinds: dict[str, str] | None = None, missing: tuple[str, ...] = (), stratify: str | None = None, width: int = 10, permutations: int = 0, bootstrap: int = 0, seed: int = 1, min_cell: int | None = None, min_networks: int = mates.MIN_STRATUM_NETWORKS) -> Result:
    """With ``min_cell``, only the cells that the gates let pass, and of them the listed fields."""
    p = Pedigree(raw, options)
    tokens = stored(trait_tokens(p.ped.select("id"), raw, options.id, traits, missing), "traits")
    typed = {t: mates.classify_trait(tokens.select(F.col(t).alias("token")), (kinds or {}).get(t)) for t in traits}
    values = tokens
    for t, (kind, codes) in typed.items():
        own = F.lower(F.trim(t))
        value = own.try_cast("double") if kind == "continuous" else F.element_at(F.create_map(*(F.lit(x) for k, v in codes.items() for x in (k, float(v)))), own)
        values = values.withColumn(t, value)
    pairs = mates.mate_values(p.ped, values, traits)
    drops: dict[str, Any] = {}
    if stratify:
        a, b = traits[0], traits[-1]
        pairs = stored(pairs.join(mates.pair_strata(p.ped.join(p.depth, "id"), width if stratify == "birth_year" else None), ["mother", "father"]), "strata")
        drops = row(mates.drop_counts(pairs, a, b))
        pairs, more = mates.full_strata(pairs, a, b, min_networks)
        drops |= more
        own = {f"m_{a}": (a, "mother_stratum"), f"f_{b}": (b, "father_stratum")}
        pairs = pairs.withColumns({c: mates.within_strata(pairs, c, by) for c, (t, by) in own.items() if typed[t][0] == "continuous"})
    pairs, nets = stored(pairs, "mate-values"), stored(mates.mate_networks(p.ped), "networks")
    if min_cell is not None and stratify:
        raise Unsupported("--safe-attempt with --stratify-by isn't built")
    if min_cell is not None:
        fitted = {(x, y): "continuous" not in (typed[x][0], typed[y][0]) for x, y in safe_mates.cells(traits)}
        table = stored(safe_mates.gates(pairs, values, traits, fitted), "gates")
        decided = stored(safe_mates.decisions(table, min_cell, fitted, traits), "decisions")
        passed = {r["cell"] for r in decided.where("released").collect()}  # at most four cells
        found = {f"{x}x{y}": mates.estimate(pairs, nets, x, y, (typed[x][0], typed[y][0])) if f"{x}x{y}" in passed else {} for x, y in safe_mates.cells(traits)}
        couples = table.where("gate = 'couples'").first()
        shown = disclosure.protect_count(couples["n"], couples["units"], min_cell)
        return Result({"min_cell": min_cell, "mating_pairs": shown, "mate_correlation": safe_mates.release(found, decided)})
    a, b = traits[0], traits[-1]
    out: dict[str, Any] = {"drops": drops or row(mates.drop_counts(pairs, a, b)), "kinds": {t: k for t, (k, _) in typed.items()}}
    kinds_ = (typed[a][0], typed[b][0])
    fitted_ = mates.fit(pairs, nets, a, b, kinds_, bool(stratify))
    out["primary"] = fitted_.record
    if typed[a][0] == typed[b][0] == "continuous":
        out["spearman"] = row(mates.spearman(pairs, a, b))
    if typed[a][0] == typed[b][0] == "binary":
        out["table"] = row(mates.two_by_two(pairs, a, b))
    if a != b:
        out["within_person"] = row(mates.cross_trait(p.ped, values, a, b))
    if permutations:
        others = tuple(f"f_{t}" for t in traits if f"f_{t}" in pairs.columns and t != b)
        out["p_permutation"], out["draws"] = mates.permutation_p(pairs, a, b, permutations, seed, stratum_column="father_stratum" if stratify else None, kinds=kinds_, blocks=others)
    if bootstrap:
        draws = mates.bootstrap(fitted_.scores, fitted_.record["estimate"], fitted_.information, bootstrap, seed)
        got = draws.agg(F.stddev_samp("estimate").alias("se"), F.percentile("estimate", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).first()
        out["bootstrap"] = {"se": got["se"], "ci_low": got["ci"][0], "ci_high": got["ci"][1], "draws": bootstrap}
    return Result({"mate_correlation": out})


def relatives_input(raw: DataFrame, options: validation.Options, kinds: tuple[str, ...] = relatives.DEFAULT, base_year: int = 1900, drop_founders: bool = False, exact_kinship: bool = False, disorder: str = "trait1") -> Result:
    p = Pedigree(raw, options)
    lineage = {k: relatives.lineage_avuncular(p.ped, p.families.couples(), r) for k, r in (("mAv", "mother"), ("pAv", "father")) if k in kinds}
    pairs = stored(relatives.relative_pairs(p.pairs(3), kinds, lineage), "relative-pairs")
    table = relatives.skeleton(p.ped, pairs, kinds, p.depth, base_year, drop_founders).withColumn("disorder", F.lit(disorder))
    if exact_kinship:
        pairs = ancestry.pair_kinship(pairs.withColumnRenamed("kinship", "nominal"), p.shares, p.inbred).withColumnsRenamed({"kinship": "kinship_exact", "nominal": "kinship"})
    return Result({"diagnostics": keyed(relatives.relationship_diagnostics(table), "kind")}, {"skeleton": table.orderBy("kind", "id"), "pairs": pairs.orderBy("kind", "id1", "id2")})


__all__ = ["Blocked", "Pedigree", "Result", "SparkSession", "Unsupported", "assortative_mating", "effective_sizes", "read_aligned", "relatives_input", "safe_summary", "summarize", "validate"]
