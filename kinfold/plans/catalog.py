"""The queries by operator name, over the derived pedigree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.distributions import FIELDS
from kinfold.operators import ancestry, births, concordance, disclosure, relatives, relationships, safe_mates, safe_size, sections
from kinfold.operators import effective_size as ne
from kinfold.operators import mates as mt
from kinfold.operators.graph import cycle_components, edges, pedigree_components
from kinfold.operators.individual import COLUMNS, individual_table, mating_pairs, one_hop, offspring_counts
from kinfold.plans import files, fixing, scenarios, validation
from kinfold.plans.derived import Derived, dirty
from kinfold.plans.oracles import DIRTY, ORACLES, PARTIAL, PEDIGREE
from kinfold.session import numbered, stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _round(df: DataFrame, places: int = 8) -> DataFrame:
    """Doubles rounded: sums of doubles depend on their order."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@_query
def structural_depth(spark, sf):
    return Derived(spark, sf).depth


@_query
def parent_child_edges(spark, sf):
    return edges(Derived(spark, sf).ped)


@_query
def ancestor_closure(spark, sf):
    return Derived(spark, sf).paths


@_query
def connected_components(spark, sf):
    return pedigree_components(Derived(spark, sf).ped)


@_query
def mate_networks(spark, sf):
    return mt.mate_networks(Derived(spark, sf).ped)


@_query
def one_hop_relative_counts(spark, sf):
    return one_hop(Derived(spark, sf).ped)


@_query
def offspring_count(spark, sf):
    return offspring_counts(Derived(spark, sf).ped)


@_query
def mating_pair_table(spark, sf):
    return mating_pairs(Derived(spark, sf).ped)


def _individual(d: Derived, *columns: str) -> DataFrame:
    """The individual table, or the given columns of it."""
    return d._once("individual", lambda: individual_table(d.ped, families=d.families, columns=columns or COLUMNS))


_STRATUM = ("sex", "ped_depth", "is_founder", "F", "n_offspring", "n_mates", "n_full_sibs")
_DISTRIBUTED = ("n_offspring", "n_full_sibs", "n_descendant_paths", "ecg", "F")


@_query
def individual_table_(spark, sf):
    return _round(_individual(Derived(spark, sf)))


_QUERIES["individual_table"] = _QUERIES.pop("individual_table_")


@_query
def descendant_path_counts(spark, sf):
    d = Derived(spark, sf)
    return ancestry.descendant_paths(d.ped, d.paths)


@_query
def distinct_ancestor_counts(spark, sf):
    d = Derived(spark, sf)
    return ancestry.distinct_ancestors(d.ped, d.paths)


@_query
def founder_ancestor_counts(spark, sf):
    d = Derived(spark, sf)
    return ancestry.founder_ancestors(d.ped, d.paths)


@_query
def equivalent_complete_generations(spark, sf):
    d = Derived(spark, sf)
    return _round(ancestry.ecg(d.ped, d.paths))


@_query
def inbreeding_coefficients(spark, sf):
    return _round(Derived(spark, sf).inbred)


@_query
def mating_pair_kinship(spark, sf):
    d = Derived(spark, sf)
    return _round(d.families.couples().withColumnsRenamed({"mother": "id1", "father": "id2"}))


@_query
def mean_kinship_by_depth(spark, sf):
    d = Derived(spark, sf)
    return _round(d.families.by_depth())


@_query
def numeric_distribution(spark, sf):
    return _round(sections.distributions(_individual(Derived(spark, sf), *_DISTRIBUTED), _DISTRIBUTED))


@_query
def size_structure(spark, sf):
    d = Derived(spark, sf)
    return _round(sections.size_structure(d.ped, d.depth, pedigree_components(d.ped)))


@_query
def depth_counts(spark, sf):
    return sections.depth_counts(Derived(spark, sf).depth)


@_query
def largest_components(spark, sf):
    return sections.largest_components(pedigree_components(Derived(spark, sf).ped))


@_query
def mating_pair_summary(spark, sf):
    return _round(sections.mating_pair_summary(Derived(spark, sf).ped))


@_query
def sibship_sizes(spark, sf):
    return _round(sections.sibship_sizes(Derived(spark, sf).ped))


@_query
def reproduction_counts(spark, sf):
    return _round(sections.reproduction(_individual(Derived(spark, sf), "sex", "mother", "father", "n_offspring", "n_mates", "n_full_sibs")))


@_query
def genealogy_distributions(spark, sf):
    return _round(sections.genealogy(_individual(Derived(spark, sf), "n_descendant_paths", "n_distinct_ancestors")))


@_query
def founder_contribution(spark, sf):
    return _round(sections.founder_contribution(_individual(Derived(spark, sf), "is_founder", "n_descendant_paths")))


@_query
def founder_summary_by_depth(spark, sf):
    d = Derived(spark, sf)
    return _round(d.families.founder_summary())


@_query
def component_summary(spark, sf):
    return _round(sections.component_summary(pedigree_components(Derived(spark, sf).ped)))


@_query
def sex_summary(spark, sf):
    return _round(sections.sex_summary(_individual(Derived(spark, sf), *_STRATUM)))


@_query
def depth_summary(spark, sf):
    return _round(sections.depth_summary(_individual(Derived(spark, sf), *_STRATUM)))


@_query
def inbreeding_summary(spark, sf):
    return _round(sections.inbreeding_summary(_individual(Derived(spark, sf))))


@_query
def inbreeding_histogram(spark, sf):
    return sections.inbreeding_histogram(_individual(Derived(spark, sf)))


@_query
def family_support(spark, sf):
    d = Derived(spark, sf)
    return sections.unit_support(sections.family_id(d.ped).join(d.ped, "id"), "sex", "family")


@_query
def contingency_table(spark, sf):
    return sections.contingency(Derived(spark, sf).ped, "sex", "segment")


def _kin(d: Derived, most: int = 5) -> relationships.Kin:
    return relationships.Kin(d.ped, None, most, d.twins)


def _pairs(d: Derived, most: int = 5) -> DataFrame:
    return d._once(f"pairs{most}", lambda: _kin(d, most).pairs())


@_query
def relationship_pairs(spark, sf):
    """To the second degree: longer lists serve counts only."""
    return _pairs(Derived(spark, sf), 2)


@_query
def relationship_counts(spark, sf):
    return _kin(Derived(spark, sf)).counts()


@_query
def relationship_burden(spark, sf):
    return _kin(Derived(spark, sf)).burden()


@_query
def related_density_by_depth(spark, sf):
    d = Derived(spark, sf)
    return _round(_kin(d).density(d.depth))


@_query
def ne_inbreeding(spark, sf):
    d = Derived(spark, sf)
    return _round(ne.ne_inbreeding(d.families.by_depth()), 6)


@_query
def ne_coancestry(spark, sf):
    d = Derived(spark, sf)
    return _round(ne.ne_coancestry(d.families.by_depth()), 6)


@_query
def ne_group_coancestry(spark, sf):
    d = Derived(spark, sf)
    return _round(ne.ne_group_coancestry(d.families.by_depth()), 6)


@_query
def ne_sex_ratio(spark, sf):
    d = Derived(spark, sf)
    return _round(ne.ne_sex_ratio(d.ped, d.depth), 6)


@_query
def ne_variance_family_size(spark, sf):
    d = Derived(spark, sf)
    return _round(ne.variance_by_depth(d.ped, d.depth), 6)


@_query
def ne_individual_delta_f(spark, sf):
    d = Derived(spark, sf)
    return _round(ne.ne_individual_delta_f(d.families.persons), 6)


@_query
def ne_long_term_contributions(spark, sf):
    d = Derived(spark, sf)
    return _round(ne.ne_long_term_contributions(d.ped, d.families.founder_contributions(), d.depth), 8)


@_query
def ne_hill_overlapping(spark, sf):
    return _round(ne.hill_by_cohort(Derived(spark, sf).dated), 6)


@_query
def sex_concordance_groups(spark, sf):
    return concordance.groups(Derived(spark, sf).ped, "full_siblings")


@_query
def sex_concordance_by_size(spark, sf):
    return concordance.by_size(concordance.groups(Derived(spark, sf).ped, "maternal"))


@_query
def sex_concordance_sums(spark, sf):
    got = concordance.sums(concordance.groups(Derived(spark, sf).ped, "paternal"))
    return got.select(*(F.col(c).cast("long").alias(c) for c in got.columns))


@_query
def sex_concordance_permutations(spark, sf):
    """The rows-only check: 1,000 seeded draws over the full sibships."""
    return concordance.permutations(spark, concordance.groups(Derived(spark, sf).ped, "full_siblings"), 1000)


def _births(d: Derived) -> DataFrame:
    day = F.expr("date_add(date'1950-01-01', cast(floor(id / 4) % 300 * 3 + (id % 4) * (id % 3) * 4 as int))")
    return d.dated.withColumn("birth_date", day).withColumn("row", F.col("id"))


@_query
def multiple_birth_sets(spark, sf):
    return births.birth_sets(_births(Derived(spark, sf)), 7)


@_query
def multiple_births_by_size(spark, sf):
    b = _births(Derived(spark, sf))
    return _round(births.births_by_size(b.join(births.birth_sets(b, 7), "id", "left")))


@_query
def twin_pairs_by_sex(spark, sf):
    b = _births(Derived(spark, sf))
    return births.twin_pairs_by_sex(b.join(births.birth_sets(b, 7), "id", "left"), by_decade=True)


def _relatives(d: Derived) -> DataFrame:
    return relatives.relative_pairs(_pairs(d, 3))


@_query
def relative_pairs(spark, sf):
    d = Derived(spark, sf)
    kinds = ("FS", "HS", "Av", "1C")
    return relatives.relative_pairs(_pairs(d, 3), kinds)


@_query
def relatives_skeleton(spark, sf):
    d = Derived(spark, sf)
    got = relatives.skeleton(d.dated.drop("depth"), _relatives(d), depth=d.depth)
    return got.select("kind", "id", F.col("sex").cast("int").alias("sex"), F.col("born_at_year").cast("int").alias("born_at_year"), "n_relatives")


@_query
def relationship_diagnostics(spark, sf):
    d = Derived(spark, sf)
    return _round(relatives.relationship_diagnostics(relatives.skeleton(d.dated.drop("depth"), _relatives(d))))


@_query
def lineage_avuncular(spark, sf):
    d = Derived(spark, sf)
    return relatives.lineage_avuncular(d.ped, d.families.couples(), "mother")


# Checks over the dirty variant ---------------------------------------------------------------------------------------

_OPTIONS = files.DIRTY


def _report(spark: SparkSession, sf: str) -> validation.Report:
    return validation.validate(stored(dirty(spark, sf), "dirty"), _OPTIONS)


@_query
def validation_findings(spark, sf):
    """Status and findings of each of the 33 checks."""
    return scenarios.by_check(_report(spark, sf))


@_query
def sex_imputation(spark, sf):
    return _report(spark, sf).context.ped.select("id", "sex", "sex_source")


@_query
def synthesized_founders(spark, sf):
    return fixing.synthesized_founders(_report(spark, sf).context.ped)


@_query
def phantom_parents(spark, sf):
    c = _report(spark, sf).context
    return fixing.phantom_parents(c.ped, c.integer)[0].select("id", "mother", "father")


@_query
def fixed_pedigree(spark, sf):
    return fixing.fix(_report(spark, sf)).select("id", "sex", "sex_source", "mother", "father", "ped_depth")


@_query
def reduction(spark, sf):
    """What drop mode removes: the rows-only check of a fixpoint."""
    raw = stored(dirty(spark, sf), "dirty")
    return fixing.reduce_pedigree(raw, validation.with_options(_OPTIONS, max_children_mother=None, max_children_father=None)).dropped


# Mate correlation ----------------------------------------------------------------------------------------------------


def _mates(d: Derived) -> DataFrame:
    traits = d.ped.select("id", F.col("acctbal").alias("x"), (F.col("acctbal") > 4000).cast("double").alias("b"), F.floor(F.col("acctbal") / 3000).cast("double").alias("o"))
    return mt.mate_values(d.ped, traits, ["x", "b", "o"])


@_query
def mate_values(spark, sf):
    return _mates(Derived(spark, sf))


@_query
def mate_pearson(spark, sf):
    return _round(mt.pearson(_mates(Derived(spark, sf)), "x", "x"))


@_query
def mate_spearman(spark, sf):
    return _round(mt.spearman(_mates(Derived(spark, sf)), "x", "o"))


@_query
def mate_table_2x2(spark, sf):
    return _round(mt.two_by_two(_mates(Derived(spark, sf)), "b", "b"))


@_query
def mate_point_biserial(spark, sf):
    return _round(mt.pearson(_mates(Derived(spark, sf)), "x", "b"))


@_query
def mate_contingency(spark, sf):
    return mt.cross_table(_mates(Derived(spark, sf)), "o", "o")


@_query
def mate_latent_correlations(spark, sf):
    """Tetrachoric, polychoric, biserial and polyserial estimates with network standard errors: a rows-only check."""
    d = Derived(spark, sf)
    m, nets = _mates(d), mt.mate_networks(d.ped)
    rows = [mt.estimate(m, nets, a, b, kinds) for a, b, kinds in (("b", "b", ("binary", "binary")), ("o", "o", ("ordinal", "ordinal")), ("x", "b", ("continuous", "binary")), ("x", "o", ("continuous", "ordinal")), ("x", "x", ("continuous", "continuous")))]
    return spark.createDataFrame([(r["estimator"], r["n"], r["estimate"], r["se"], r["ci_low"], r["ci_high"]) for r in rows], "estimator string, n long, estimate double, se double, ci_low double, ci_high double")


@_query
def trait_levels(spark, sf):
    return mt.trait_levels(Derived(spark, sf).ped.select(F.col("segment").alias("token")))


@_query
def mate_strata(spark, sf):
    return mt.pair_strata(Derived(spark, sf).dated, width=10)


@_query
def protected_depth_table(spark, sf):
    """Counts by depth with small cells merged inward."""
    rows = [(r["depth"], r["n"]) for r in sections.depth_counts(Derived(spark, sf).depth).orderBy("depth").collect()]
    return _cells(spark, disclosure.protect_ordered(rows, min_cell=100))


@_query
def mate_full_strata(spark, sf):
    """Pairs left once thin and degenerate strata are dropped, to a fixed point."""
    d = Derived(spark, sf, whole=False)
    pairs = stored(_mates(d).join(mt.pair_strata(d.dated, width=10), ["mother", "father"]), "strata")
    return mt.full_strata(pairs, "o", "x", 6)[0].select("mother", "father")


def _gates(d: Derived) -> DataFrame:
    cohorts = d.families.by_depth()
    return d._once("gates", lambda: safe_size.gates(d.dated.drop("depth"), d.depth, d.families.persons, cohorts, d.twins))


@_query
def safe_size_gates(spark, sf):
    """The counts that effective sizes rest on, with half-founders, unknown sexes and twins."""
    return _gates(Derived(spark, sf, whole=False))


@_query
def safe_size_decisions(spark, sf):
    return safe_size.decisions(_gates(Derived(spark, sf, whole=False)), 5)


def _mate_gates(d: Derived) -> DataFrame:
    """Two traits with gaps: a level by thousands, and a sign."""
    v = F.col("acctbal")
    people = d.ped.select("id", F.when(F.col("id") % 7 != 1, F.floor(v / 3000).cast("double")).alias("o"), F.when(F.col("id") % 5 != 2, (v > 4000).cast("double")).alias("b"))
    pairs = mt.mate_values(d.ped, people, ["o", "b"])
    return d._once("mate-gates", lambda: safe_mates.gates(pairs, people, ["o", "b"], dict.fromkeys(safe_mates.cells(["o", "b"]), True)))


@_query
def safe_mate_gates(spark, sf):
    return _mate_gates(Derived(spark, sf))


@_query
def safe_mate_decisions(spark, sf):
    return safe_mates.decisions(_mate_gates(Derived(spark, sf)), 5, dict.fromkeys(safe_mates.cells(["o", "b"]), True), ["o", "b"])


@_query
def birth_sets_by_decade(spark, sf):
    b = _births(Derived(spark, sf))
    return births.sets_by_decade(b.join(births.birth_sets(b, 7), "id", "left"))


@_query
def recorded_sex_source(spark, sf):
    """The fixed pedigree with the input's own sex_source kept where this run would say input."""
    raw = dirty(spark, sf).withColumn("sex_source", F.when(F.col("id").cast("long") % 9 == 4, "imputed_from_role").when(F.col("id").cast("long") % 9 == 5, "input"))
    return fixing.fix(validation.validate(stored(raw, "dirty"), _OPTIONS)).select("id", "sex_source")


def _cells(spark, cells) -> DataFrame:
    return spark.createDataFrame([(c.label, c.count, c.status) for c in cells], "label string, n long, status string")


@_query
def protected_offspring_table(spark, sf):
    """Numbers of offspring with small cells merged inward."""
    got = one_hop(Derived(spark, sf).ped).groupBy("n_offspring").agg(F.count("*").alias("n")).orderBy("n_offspring").collect()
    return _cells(spark, disclosure.protect_ordered([(r["n_offspring"], r["n"]) for r in got], 20))


@_query
def protected_half_founders(spark, sf):
    """A table whose cells are all or none shown, and counts gated by the families behind them."""
    d = Derived(spark, sf, whole=False)
    known = F.when(F.col("mother").isNull() & F.col("father").isNull(), "none").when(F.col("mother").isNull(), "father").when(F.col("father").isNull(), "mother").otherwise("both")
    rows = d.ped.select("id", F.coalesce("sex", F.lit("unknown")).alias("sex"), known.alias("known"))
    cells = {(r["sex"], r["known"]): r["n"] for r in rows.groupBy("sex", "known").agg(F.count("*").alias("n")).collect()}
    units = {r["known"]: (r["n"], r["u"]) for r in rows.join(sections.family_id(d.ped), "id").groupBy("known").agg(F.count("*").alias("n"), F.countDistinct("family").alias("u")).collect()}
    out = [(f"{a}/{b}", n) for (a, b), n in disclosure.protect_contingency(cells, 3).items()]
    out += [(k, disclosure.protect_count(n, u, 20)) for k, (n, u) in units.items()]
    return spark.createDataFrame(out, "label string, n long")


@_query
def safe_pair_support(spark, sf):
    """Pairs by code, and the fewest families or ancestors behind them."""
    from kinfold.plans.reports import pair_support

    d = Derived(spark, sf, whole=False)
    return pair_support(d.ped, _kin(d, 3).pairs())


@_query
def protected_categories(spark, sf):
    """Small categories in one, which takes in the smallest shown category if it stays small itself."""
    ped = Derived(spark, sf).ped.select(F.when(F.col("id") % 7 == 3, "rare").when(F.col("id") % 11 == 3, "rarer").otherwise(F.col("segment")).alias("k"))
    got = [(r["k"], r["n"]) for r in ped.groupBy("k").agg(F.count("*").alias("n")).collect()]
    least = sorted(n for _, n in got)[1] + 1  # the two smallest are small
    return _cells(spark, disclosure.protect_unordered(got, max(least, 3)))


@_query
def sex_concordance_moments(spark, sf):
    """Pairs, concordant pairs, exact mean and variance, and z, by grouping."""
    d = Derived(spark, sf, whole=False)
    rows = []
    for g in ("full_siblings", "maternal", "paternal"):
        t = concordance.test(concordance.groups(d.ped, g))
        rows.append((g, t["pairs"], t["concordant"], t["expected"], t["variance"], t["z"]))
    return _round(spark.createDataFrame(rows, "grouping string, pairs long, concordant long, expected double, variance double, z double"), 6)


@_query
def sex_concordance_skips(spark, sf):
    """Why a grouping isn't tested."""
    ped = Derived(spark, sf).ped
    one = ped.where("mother is not null").agg(F.min("mother")).first()[0]
    cases = {"no sex": ped.withColumn("sex", F.lit(None).cast("string")), "one group": ped.where((F.col("mother") == one) | F.col("mother").isNull()), "one sex": ped.where("sex = 'M'")}
    rows = [(k, concordance.test(concordance.groups(v, "maternal")).get("skipped", "")) for k, v in cases.items()]
    return spark.createDataFrame(rows, "case string, skipped string")


@_query
def cycle_members(spark, sf):
    """Members of cycles in the variant whose births are out of order."""
    report = validation.validate(stored(scenarios.raw_table(spark, sf, scenarios.SCENARIOS["checks_births"]), "faulty"))
    return cycle_components(report.context.ped, report.context.depths())


@_query
def topological_order(spark, sf):
    """Place of each person if ancestors come first, and rows in their order within a depth."""
    d = Derived(spark, sf, whole=False)
    return numbered(d.ped.join(d.depth, "id").select("id", "depth"), "depth", "id", name="place").select("id", "place")


@_query
def command_exit_codes(spark, sf):
    """The commands on clean, faulty and blocked tables, and with options that contradict each other."""
    from kinfold.plans.files import command_codes

    return spark.createDataFrame(command_codes(spark), "command string, case string, code int, files string")


# Half-founders, unknown sexes, linked twins --------------------------------------------------------------------------


def _partial(name: str) -> Query:
    """A query over the pedigree with gaps and twins."""

    def run(spark, sf):
        if name == "relationship_pairs":
            return _kin(Derived(spark, sf, whole=False)).pairs()
        return _BY_PEDIGREE[name](Derived(spark, sf, whole=False))

    return run


_BY_PEDIGREE: dict[str, Callable[[Derived], DataFrame]] = {
    "individual_table": lambda d: _round(_individual(d)),
    "one_hop_relative_counts": lambda d: one_hop(d.ped),
    "size_structure": lambda d: _round(sections.size_structure(d.ped, d.depth, pedigree_components(d.ped))),
    "equivalent_complete_generations": lambda d: _round(ancestry.ecg(d.ped, d.paths)),
    "inbreeding_coefficients": lambda d: _round(d.inbred),
    "mating_pair_kinship": lambda d: _round(d.families.couples().withColumnsRenamed({"mother": "id1", "father": "id2"})),
    "mean_kinship_by_depth": lambda d: _round(d.families.by_depth()),
    "family_support": lambda d: sections.unit_support(sections.family_id(d.ped).join(d.ped, "id"), "sex", "family"),
    "sex_summary": lambda d: _round(sections.sex_summary(_individual(d, *_STRATUM))),
    "founder_summary_by_depth": lambda d: _round(d.families.founder_summary()),
    "founder_contribution": lambda d: _round(sections.founder_contribution(_individual(d, "is_founder", "n_descendant_paths"))),
    "relationship_counts": lambda d: _kin(d).counts(),
    "relationship_burden": lambda d: _kin(d).burden(),
    "related_density_by_depth": lambda d: _round(_kin(d).density(d.depth)),
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES) | {to: _partial(name) for name, (to, _) in PARTIAL.items()} | scenarios.queries() | files.queries()


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()} | scenarios.oracle_sql(PEDIGREE) | files.oracle_sql(PEDIGREE, DIRTY, ORACLES["fixed_pedigree"], ORACLES["validation_findings"])


__all__ = ["FIELDS", "oracle_sql", "queries"]
