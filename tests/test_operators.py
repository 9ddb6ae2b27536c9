"""Hand-built pedigrees with known answers, and conservation laws."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import normal
from kinfold.operators import ancestry, births, concordance, disclosure, mates, relationships, sections
from kinfold.operators.families import Families
from kinfold.operators.graph import closure, components, cycle_components, structural_depth
from kinfold.operators.individual import individual_table, one_hop


def pedigree(spark, rows):
    return spark.createDataFrame(rows, "id long, sex string, mother long, father long")


# Two couples; sibs 5, 6; each has a child with an outsider: 7 and 8 are first cousins.
COUSINS = [(1, "M", None, None), (2, "F", None, None), (3, "F", None, None), (4, "M", None, None), (5, "M", 2, 1), (6, "F", 2, 1), (7, "F", 3, 5), (8, "M", 6, 4)]
# Full sibs 3 and 4 mate.
SIBS = [(1, "M", None, None), (2, "F", None, None), (3, "M", 2, 1), (4, "F", 2, 1), (5, "M", 4, 3), (6, "F", 4, 3)]


def coded(spark, rows, most=5):
    ped = pedigree(spark, rows)
    return {(r["id1"], r["id2"]): r["code"] for r in relationships.relationship_pairs(ped, closure(ped, most), most).collect()}


def test_cousins(spark):
    got = coded(spark, COUSINS)
    assert got[(7, 8)] == "1C" and got[(5, 6)] == "FS" and got[(7, 6)] == got[(8, 5)] == "Av"
    assert sum(c in ("MO", "FO") for c in got.values()) == 8 and sum(c == "GP" for c in got.values()) == 4


def test_degrees_beyond_the_limit_are_none(spark):
    ped = pedigree(spark, COUSINS)
    n = relationships.relationship_counts(relationships.relationship_pairs(ped, closure(ped, 2), 2), 2)
    assert n["1C"] is None and n["FS"] == 1 and n["PO"] == 8 and n["by_degree"][3] is None


def test_inbred_sibs(spark):
    ped = pedigree(spark, SIBS)
    shares = ancestry.contributions(closure(ped))
    inbred = ancestry.inbreeding(ped, shares, structural_depth(ped))
    assert {r["id"]: r["F"] for r in inbred.collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0.25, 6: 0.25}
    pairs = spark.createDataFrame([(5, 6), (1, 2), (3, 4)], "id1 long, id2 long")
    assert {(r["id1"], r["id2"]): r["kinship"] for r in ancestry.pair_kinship(pairs, shares, inbred).collect()} == {(5, 6): 0.375, (1, 2): 0.0, (3, 4): 0.25}


def test_cohort_kinship_is_the_mean_of_pairs(spark):
    ped = pedigree(spark, SIBS)
    depth, shares = structural_depth(ped), ancestry.contributions(closure(ped))
    inbred = ancestry.inbreeding(ped, shares, depth)
    got = {r["cohort"]: r for r in ancestry.cohort_kinship(depth.select("id", F.col("depth").alias("cohort")), shares, inbred).collect()}
    assert got[2]["mean_kinship"] == pytest.approx(0.375) and got[2]["group_kinship"] == pytest.approx((0.375 * 2 + 0.625 * 2) / 4)


def test_ecg(spark):
    # One parent known; both known; three generations.
    rows = [(1, "M", None, None), (2, "F", None, None), (3, "F", 2, 1), (4, "M", None, None), (5, "F", 3, 4), (6, "M", 2, 4), (7, "M", 5, 6)]
    got = {r["id"]: r["ecg"] for r in ancestry.ecg(pedigree(spark, rows), closure(pedigree(spark, rows))).collect()}
    assert [got[i] for i in range(1, 8)] == [0, 0, 1, 0, 1.5, 1, 2.25]


def test_cycles(spark):
    rows = [(1, "F", 2, None), (2, "F", 1, None), (3, "M", 1, None), (4, "M", None, None), (5, "F", 6, 4), (6, "F", 7, None), (7, "F", 5, None), (8, "F", 8, None), (9, "F", 8, None)]
    ped = pedigree(spark, rows)
    depth = {r["id"]: r["depth"] for r in structural_depth(ped).collect()}
    assert depth[4] == 0 and all(depth[i] is None for i in (1, 2, 3, 5, 6, 7, 8, 9))
    assert {r["id"]: r["cycle"] for r in cycle_components(ped).collect()} == {1: 1, 2: 1, 5: 5, 6: 5, 7: 5}


def test_one_hop(spark):
    got = {r["id"]: r for r in one_hop(pedigree(spark, COUSINS)).collect()}
    assert got[7]["n_first_cousins"] == 1 and got[7]["n_uncles_aunts"] == 1 and got[1]["n_grandchildren"] == 2 and got[5]["n_full_sibs"] == 1
    assert got[5]["n_mat_half_sibs"] == 0 and got[7]["n_grandparents"] == 2 and got[2]["n_mates"] == 1


def test_founders_count_themselves(spark):
    got = {r["id"]: r["n_founder_ancestors"] for r in individual_table(pedigree(spark, COUSINS)).collect()}
    assert got[1] == 1 and got[5] == 2 and got[7] == 3


@st.composite
def pedigrees(draw):
    n = draw(st.integers(2, 14))
    rows = []
    for i in range(n):
        mothers = [r[0] for r in rows if r[1] == "F"]
        fathers = [r[0] for r in rows if r[1] == "M"]
        rows.append((i, draw(st.sampled_from("FM")), draw(st.sampled_from([None, *mothers])), draw(st.sampled_from([None, *fathers]))))
    return rows


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=pedigrees())
def test_against_matrices(spark, rows):
    """Kinship by the tabular method, ancestors and depth by recursion."""
    n = len(rows)
    k, anc, depth = np.zeros((n, n)), [set() for _ in range(n)], [0] * n
    for i, _, m, f in rows:
        parents = [p for p in (m, f) if p is not None]
        for j in range(i):
            k[i, j] = k[j, i] = sum(k[p, j] for p in parents) / 2
        k[i, i] = 0.5 + (k[m, f] / 2 if len(parents) == 2 else 0)
        anc[i] = set().union(*({p} | anc[p] for p in parents)) if parents else set()
        depth[i] = max((depth[p] + 1 for p in parents), default=0)
    ped = pedigree(spark, rows)
    paths, d = closure(ped), structural_depth(ped)
    assert {r["id"]: r["depth"] for r in d.collect()} == dict(enumerate(depth))
    assert {r["id"]: r["n_distinct_ancestors"] for r in ancestry.distinct_ancestors(ped, paths).collect()} == {i: len(a) for i, a in enumerate(anc)}
    shares = ancestry.contributions(paths)
    inbred = ancestry.inbreeding(ped, shares, d)
    assert {r["id"]: round(r["F"], 9) for r in inbred.collect()} == {i: round(2 * k[i, i] - 1, 9) for i in range(n)}
    pairs = relationships.relationship_pairs(ped, closure(ped, 5), 5)
    seen = [frozenset((r["id1"], r["id2"])) for r in pairs.collect()]
    assert len(seen) == len(set(seen))
    total = pairs.count()
    burden = relationships.relationship_burden(ped, pairs).select(sum(F.col(f"degree_{x}") for x in range(1, 6)).alias("s")).agg(F.sum("s")).first()[0]
    assert burden == 2 * total


def test_families_agree_with_paths_of_persons(spark):
    """Families with one known parent, parents without a row, one person as both parents, backcrosses."""
    rng = np.random.default_rng(3)
    rows = [(i, "M", None, None) for i in range(6)]
    for i in range(6, 80, 3):
        m, f = (int(x) for x in rng.integers(max(0, i - 25), i, 2))
        m, f = (None if i % 5 == 1 else m), (None if i % 7 == 4 else 999 if i % 11 == 5 else f)
        rows += [(i + k, "F", m, f) for k in range(3)]
    ped = pedigree(spark, rows)
    depth, paths = structural_depth(ped), closure(ped)
    shares = ancestry.contributions(paths)
    inbred = ancestry.inbreeding(ped, shares, depth)
    fam = Families(ped, depth)

    def same(got, want):
        values = [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*want.columns).collect()), key=str) for df in (got, want)]
        assert values[0] == values[1] and values[0]

    same(fam.inbred, inbred)
    for want in (ancestry.ecg(ped, paths), ancestry.distinct_ancestors(ped, paths), ancestry.founder_ancestors(ped, paths)):
        same(fam.persons, want)
    same(fam.descendant_paths(), ancestry.descendant_paths(ped, paths).where("n_descendant_paths > 0"))
    same(fam.by_depth(), ancestry.cohort_kinship(depth.select("id", F.col("depth").alias("cohort")), shares, inbred))
    pairs = ped.where("mother is not null and father is not null and father < 999").selectExpr("mother as id1", "father as id2").distinct()
    same(fam.couples().where("father < 999").withColumnsRenamed({"mother": "id1", "father": "id2"}), ancestry.pair_kinship(pairs, shares, inbred))
    same(fam.founder_summary(), sections.founder_summary(ped, paths, depth))
    held, parents = fam.breeding[0], {p for r in rows for p in r[2:]}
    assert held.select("fam").distinct().count() == len({(m, f) for i, _, m, f in rows if i in parents and {m, f} - {None, 999}})


def test_columns_of_the_individual_table(spark):
    """A few columns are those of the whole table."""
    ped = pedigree(spark, SIBS)
    whole = individual_table(ped)
    for columns in (("sex", "ped_depth", "F", "n_offspring", "n_mates", "n_full_sibs"), ("is_founder", "n_descendant_paths"), ("ped_depth", "n_grandparents")):
        got = individual_table(ped, columns=columns)
        assert set(got.columns) == {"id", *columns} and sorted(got.collect()) == sorted(whole.select(got.columns).collect())


def test_counts_by_family_are_those_of_the_pairs(spark):
    """Paths of one member of each family; a twin link between sibs, and one along a line."""
    ped = pedigree(spark, COUSINS + [(9, "F", 7, 8), (10, "F", 7, 8), (11, "M", 7, None)])
    kin = relationships.Kin(ped, None, 5, spark.createDataFrame([(5, 6), (7, 9)], "id1 long, id2 long"))
    pairs = kin.pairs()
    codes = [r["code"] for r in pairs.collect()]
    assert {r["code"]: r["n"] for r in kin.counts().collect()} == {c: codes.count(c) for c in set(codes)} and codes.count("MZ") == 2
    degree = {(r["id"], k): r[f"degree_{k}"] for r in relationships.relationship_burden(ped, pairs).collect() for k in range(1, 6)}
    assert {(r["id"], k): r[f"degree_{k}"] for r in kin.burden().collect() for k in range(1, 6)} == degree


def test_founder_summary_at_any_size(spark):
    """2,301 founders and 2,302 persons: more than five million persons x founders."""
    ped = spark.range(2300).selectExpr("id", "'M' as sex", "cast(null as long) as mother", "cast(null as long) as father")
    ped = ped.unionByName(pedigree(spark, [(9000, "F", None, None), (9001, "M", 9000, 5)]))
    got = {r["depth"]: (r["n"], r["active_founders"], r["effective_founders"], r["mean_founder_ancestors"]) for r in sections.founder_summary(ped, closure(ped), structural_depth(ped)).collect()}
    assert got == {0: (2301, 2301, 2301.0, 1.0), 1: (1, 2, 2.0, 2.0)}


def test_components(spark):
    nodes = spark.range(12)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 9), (9, 7), (10, 10)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(nodes, links).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 7, 9: 7, 10: 10, 11: 11}


def test_concordance_moments_by_enumeration():
    sizes, males = (3, 2, 2), 3
    members = [g for g, s in enumerate(sizes) for _ in range(s)]
    values = []
    for chosen in itertools.combinations(range(len(members)), males):
        c = 0
        for g, s in enumerate(sizes):
            m = sum(members[i] == g for i in chosen)
            c += math.comb(m, 2) + math.comb(s - m, 2)
        values.append(c)
    pairs = sum(math.comb(s, 2) for s in sizes)
    triples = sum(s * (s - 1) * (s - 2) for s in sizes)
    mean, var = concordance.moments(pairs, triples, len(members), males)
    exact = Fraction(sum(values), len(values))
    assert mean == exact and var == Fraction(sum(v * v for v in values), len(values)) - exact * exact


def test_concordance(spark):
    rows = [(1, "F", None, None), (2, "M", None, None), *((i, "F" if i < 6 else "M", 1, 2) for i in range(3, 9))]
    ped = pedigree(spark, [*rows, (10, "F", None, None), (11, "F", 10, 2), (12, "M", 10, 2)])
    got = concordance.concordance(ped)
    full = got["full_siblings"]["input"]
    assert full["n_groups"] == 2 and full["concordant"] == 6 and 0 <= full["p"] <= 1 and full["p_holm"] >= full["p"]
    assert concordance.test(concordance.groups(ped.where("sex = 'M'"), "full_siblings"))["skipped"] == "fewer_than_two_eligible_groups"
    draws = concordance.permutations(spark, concordance.groups(ped, "full_siblings"), 400).agg(F.avg("concordant")).first()[0]
    assert abs(draws - full["expected"]) < 0.5
    assert concordance.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])


def test_birth_sets(spark):
    df = spark.createDataFrame([(1, 10, 20, "2000-01-01"), (2, 10, 20, "2000-01-03"), (3, 10, 20, "2000-01-20"), (4, 10, 21, "2000-01-01"), (5, 10, 21, "2000-01-01"), (6, None, 21, "2000-01-01")], "id long, mother long, father long, d string").withColumn("birth_date", F.to_date("d"))
    assert {r["id"]: r["set"] for r in births.birth_sets(df, 7).collect()} == {1: 1, 2: 1, 4: 2, 5: 2}


def test_distribution(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 7.0)], "x double")
    r = sections.numeric_distribution(df, "x").first()
    assert (r["n"], r["mean"], r["q1"], r["median"], r["q3"], r["nz"]) == (4, 2.5, 0.75, 1.5, 3.25, 3) and r["std"] == pytest.approx(np.std([0, 1, 2, 7], ddof=1))
    assert sections.numeric_distribution(df.limit(1), "x").first()["std"] == 0


def test_normal():
    assert normal.bivariate(0.0, 0.0, 0.5) == pytest.approx(1 / 4 + math.asin(0.5) / (2 * math.pi), abs=1e-12)
    assert normal.bivariate(1.0, -0.5, 0.0) == pytest.approx(float(normal.cdf(1.0) * normal.cdf(-0.5)), abs=1e-14)
    assert normal.quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    cells = normal.cells(np.array([-np.inf, 0.3, np.inf]), np.array([-np.inf, -1, 1, np.inf]), -0.4)
    assert cells.sum() == pytest.approx(1)


def test_polychoric_recovers_the_correlation():
    cut = np.array([-np.inf, -0.5, 0.7, np.inf])
    r, _, info = mates.polychoric(1e5 * normal.cells(cut, cut, 0.37))
    assert r == pytest.approx(0.37, abs=1e-4) and info > 0


def test_mate_correlations(spark):
    rng = np.random.default_rng(5)
    n, r = 1500, 0.5
    x = rng.normal(size=n)
    y = r * x + math.sqrt(1 - r * r) * rng.normal(size=n)
    pairs = spark.createDataFrame([(int(i), int(n + i), float(a), float(b), float(a > 0.2), float(b > 0.2), float((b > -0.5) + (b > 0.8))) for i, a, b in zip(range(n), x, y, strict=True)], "mother long, father long, m_x double, f_x double, m_b double, f_b double, f_o double")
    nets = pairs.select(F.col("mother").alias("id"), F.col("mother").alias("network"))
    for a, b, kinds, name in (("x", "x", ("continuous",) * 2, "pearson"), ("b", "b", ("binary",) * 2, "tetrachoric"), ("x", "b", ("continuous", "binary"), "biserial"), ("x", "o", ("continuous", "ordinal"), "polyserial")):
        got = mates.estimate(pairs, nets, a, b, kinds)
        assert got["estimator"] == name and abs(got["estimate"] - r) < 4 * got["se"] and got["ci_low"] < got["estimate"] < got["ci_high"] and 0.01 < got["se"] < 0.06
    ranks = mates.spearman(pairs, "x", "x").first()
    assert ranks["n"] == n and abs(ranks["rho"] - 0.48) < 0.08
    t = mates.permutations(pairs, "x", "x", 30)
    s = {q["draw"]: q["statistic"] for q in t.collect()}
    assert s[0] == pytest.approx(n * np.corrcoef(x, y)[0, 1]) and all(abs(v) < s[0] for k, v in s.items() if k)


def test_traits(spark):
    def tokens(*values):
        return spark.createDataFrame([(v,) for v in values], "token string")

    assert mates.classify_trait(tokens("no", "YES", None)) == ("binary", {"no": 0, "yes": 1})
    assert mates.classify_trait(tokens(*map(str, range(30))))[0] == "continuous"
    assert mates.classify_trait(tokens("2", "10", "1"), "ordinal") == ("ordinal", {"1": 0, "2": 1, "10": 2})
    for bad in (tokens("1", "2", "3"), tokens("a", "b"), tokens("1", "1"), tokens(None)):
        with pytest.raises(mates.TraitError):
            mates.classify_trait(bad)


def test_disclosure():
    cells = disclosure.protect_ordered([(0, 20), (1, 3), (2, 9), (3, 2)])
    assert [(c.label, c.count, c.status) for c in cells] == [("0", 20, "intact"), ("1+", 14, "merged")]
    assert sum(c.count for c in cells) == 34
    assert [(c.label, c.count) for c in disclosure.protect_unordered([("a", 50), ("b", 6), ("c", 2)])] == [("a", 50), ("other", 8)]
    assert disclosure.protect_contingency({(0, 0): 9, (0, 1): 2})[0, 0] is None and disclosure.protect_count(7, 2) is None and disclosure.protect_count(0) == 0
    assert disclosure.continuous({"mean": 1.0, "q1": 0.5, "max": 9.0}, 10) == {"mean": 1.0, "q1": None}
    spec = [disclosure.Release("t", "ordered"), disclosure.Release("d", "derived", ("t",))]
    assert disclosure.build_release(spec, {"t": [(0, 9), (1, 9)], "d": 3.5})["d"] == 3.5
    assert disclosure.build_release(spec, {"t": [(0, 9), (1, 2)], "d": 3.5})["d"] is None
    with pytest.raises(ValueError):
        disclosure.protect_count(5, min_cell=2)
    assert disclosure.safe_message("%s of %s", disclosure.Public("x"), "secret") == "x of <str>"


def test_mate_inference(spark):
    """Bootstrap against the sandwich error for a latent correlation, strata with thresholds of their own, early stop, log-odds interval."""
    rng = np.random.default_rng(11)
    n, r = 1200, 0.4
    x = rng.normal(size=n)
    y = r * x + math.sqrt(1 - r * r) * rng.normal(size=n)
    s = rng.integers(0, 2, n)
    rows = [(int(i), int(n + i), float(a > k), float(b > 1 - k), int(k), int(k), None if i % 5 else 1.0) for i, (a, b, k) in enumerate(zip(x, y, s, strict=True))]
    pairs = spark.createDataFrame(rows, "mother long, father long, m_b double, f_b double, mother_stratum int, father_stratum int, f_o double")
    nets = pairs.select(F.col("mother").alias("id"), F.col("mother").alias("network"))
    kinds = ("binary", "binary")
    within = mates.fit(pairs, nets, "b", "b", kinds, strata=True)
    crude = mates.fit(pairs, nets, "b", "b", kinds)
    assert abs(within.record["estimate"] - r) < 4 * within.record["se"] and crude.record["estimate"] < within.record["estimate"] - 0.1
    sd = mates.bootstrap(within.scores, within.record["estimate"], within.information, 300).agg(F.stddev_samp("estimate")).first()[0]
    assert 0.75 < sd / within.record["se"] < 1.3
    p, used = mates.permutation_p(pairs, "b", "b", 400, batch=100, kinds=kinds, stratum_column="father_stratum", blocks=("f_o",))
    assert used == 400 and p < 0.01
    noise = pairs.withColumn("f_b", (F.xxhash64("father") % 2).cast("double") * F.lit(1.0))
    p, used = mates.permutation_p(noise, "b", "b", 400, batch=50, kinds=kinds)
    assert used < 400 and p > 0.04
    t = mates.two_by_two(pairs, "b", "b").first()
    assert t["odds_ratio_low"] < t["odds_ratio"] < t["odds_ratio_high"] and math.log(t["odds_ratio_high"] / t["odds_ratio_low"]) == pytest.approx(2 * 1.959963985 * t["se_log_odds"])


def test_strata_to_a_fixed_point(spark):
    """Stratum 2 spans too few networks; without its pairs stratum 5 of the fathers doesn't vary any more."""
    rows = [(i, 100 + i, float(i % 3), float(i % 4), 1, 4) for i in range(20)] + [(30 + i, 130 + i, float(i), float(i), 2, 5) for i in range(2)] + [(40 + i, 140 + i, float(i % 2), 7.0, 1, 5) for i in range(12)] + [(60, 160, 1.0, 1.0, None, 4)]
    pairs = spark.createDataFrame(rows, "mother long, father long, m_t double, f_t double, mother_stratum int, father_stratum int")
    kept, drops = mates.full_strata(pairs, "t", "t", 10)
    assert sorted(r["mother"] for r in kept.collect()) == list(range(20))
    assert drops == {"unknown_stratum": 1, "thin_stratum": 2, "degenerate_stratum": 12}
