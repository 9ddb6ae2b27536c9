"""DuckDB SQL for the queries of the catalog, written against the same tables."""

from __future__ import annotations

from kinfold.operators.relationships import CODES
from kinfold.operators.safe_size import RELEASES
from kinfold.plans.validation import CHECKS

_PED = """
ped AS (SELECT c_custkey::BIGINT AS id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
  CASE WHEN c_custkey >= 48 THEN (2 * ((37 * (c_custkey // 4) + 11) % ((c_custkey // 4) // 2 + 1)))::BIGINT END AS mother,
  CASE WHEN c_custkey >= 48 THEN (2 * ((53 * (c_custkey // 4) + 5) % ((c_custkey // 4) // 2 + 1)) + 1)::BIGINT END AS father,
  c_acctbal AS acctbal, c_mktsegment AS segment FROM customer),
edges AS (SELECT id AS child, mother AS parent, 'mother' AS role FROM ped WHERE mother IS NOT NULL UNION ALL SELECT id, father, 'father' FROM ped WHERE father IS NOT NULL)"""
PEDIGREE = _PED
#: Checks that the dirty variant's options leave out.
_OFF = ("cycle_breaks", "role_conflict_breaks", "birth_date_dtype", "birth_date_range", "birth_date_year_consistency", "birth_date_topology")
_WALKS = """,
walks AS (SELECT id, id AS anc, 0 AS gen FROM ped UNION ALL SELECT w.id, e.parent, w.gen + 1 FROM walks w JOIN edges e ON e.child = w.anc),
paths AS (SELECT id, anc, gen, count(*) AS n FROM walks GROUP BY ALL),
depth AS (SELECT id, max(gen) AS depth FROM walks GROUP BY id)"""
_SHARES = ",\nshares AS (SELECT id, anc, sum(n * pow(2.0, -gen)) AS l FROM paths GROUP BY ALL)"
_LEVELS = 7


def _inbred() -> str:
    out = ",\ninb0 AS (SELECT id, 0.0::DOUBLE AS F, 1.0::DOUBLE AS D FROM depth WHERE depth = 0)"
    for k in range(1, _LEVELS):
        out += f""",
mend{k} AS (SELECT p.id, 1 - coalesce(0.25 * (1 + m.F), 0) - coalesce(0.25 * (1 + f.F), 0) AS D FROM ped p JOIN depth d ON d.id = p.id AND d.depth = {k} LEFT JOIN inb{k - 1} m ON m.id = p.mother LEFT JOIN inb{k - 1} f ON f.id = p.father),
inb{k} AS (SELECT * FROM inb{k - 1} UNION ALL SELECT x.id, sum(s.l * s.l * coalesce(i.D, x.D)) - 1, any_value(x.D) FROM mend{k} x JOIN shares s ON s.id = x.id LEFT JOIN inb{k - 1} i ON i.id = s.anc GROUP BY x.id)"""
    return out + f",\ninbred AS (SELECT id, CASE WHEN abs(F) < 1e-12 THEN 0 ELSE F END AS F, D FROM inb{_LEVELS - 1})"


_INBRED = _inbred()
_PAIRS = ",\npairs AS (SELECT mother, father, count(*) AS n_offspring FROM ped WHERE mother IS NOT NULL AND father IS NOT NULL GROUP BY ALL)"
_COMP = """,
und AS (SELECT child AS a, parent AS b FROM edges UNION SELECT parent, child FROM edges),
cc AS (SELECT id, id AS c FROM ped UNION SELECT u.b, cc.c FROM cc JOIN und u ON u.a = cc.id WHERE cc.c < u.b),
comp AS (SELECT id, min(c) AS component FROM cc GROUP BY id)"""
_ONE = """,
ofm AS (SELECT mother AS id, count(*) AS n FROM ped WHERE mother IS NOT NULL GROUP BY 1),
off AS (SELECT father AS id, count(*) AS n FROM ped WHERE father IS NOT NULL GROUP BY 1),
noff AS (SELECT parent AS id, count(*) AS n FROM edges GROUP BY 1),
nmate AS (SELECT id, count(*) AS n FROM (SELECT mother AS id FROM pairs UNION ALL SELECT father FROM pairs) GROUP BY 1),
sib AS (SELECT p.id, p.mother, p.father, coalesce(q.n_offspring - 1, 0) AS fs, coalesce(ofm.n - 1, 0) - CASE WHEN p.mother IS NULL THEN 0 ELSE coalesce(q.n_offspring - 1, 0) END AS mh,
  coalesce(off.n - 1, 0) - CASE WHEN p.father IS NULL THEN 0 ELSE coalesce(q.n_offspring - 1, 0) END AS ph, coalesce(noff.n, 0) AS o, coalesce(nmate.n, 0) AS mates
  FROM ped p LEFT JOIN pairs q ON q.mother = p.mother AND q.father = p.father LEFT JOIN ofm ON ofm.id = p.mother LEFT JOIN off ON off.id = p.father LEFT JOIN noff ON noff.id = p.id LEFT JOIN nmate ON nmate.id = p.id),
fam AS (SELECT mother, father, sum(o) AS o FROM sib WHERE mother IS NOT NULL AND father IS NOT NULL GROUP BY ALL),
up AS (SELECT s.id, (s.mother IS NOT NULL)::INT + (s.father IS NOT NULL)::INT AS gp, s.fs, coalesce(f.o - s.o, 0) AS nn FROM sib s LEFT JOIN fam f ON f.mother = s.mother AND f.father = s.father),
gc AS (SELECT parent AS id, count(*) AS n FROM (SELECT DISTINCT y.parent, x.child FROM edges x JOIN edges y ON x.parent = y.child) GROUP BY 1),
onehop AS (SELECT s.id, s.fs::BIGINT AS n_full_sibs, s.mh::BIGINT AS n_mat_half_sibs, s.ph::BIGINT AS n_pat_half_sibs, s.o::BIGINT AS n_offspring, s.mates::BIGINT AS n_mates,
  (coalesce(m.gp, 0) + coalesce(f.gp, 0))::BIGINT AS n_grandparents, coalesce(gc.n, 0)::BIGINT AS n_grandchildren, (coalesce(m.fs, 0) + coalesce(f.fs, 0))::BIGINT AS n_uncles_aunts, (coalesce(m.nn, 0) + coalesce(f.nn, 0))::BIGINT AS n_first_cousins
  FROM sib s LEFT JOIN up m ON m.id = s.mother LEFT JOIN up f ON f.id = s.father LEFT JOIN gc ON gc.id = s.id)"""
_COUNTS = """,
dp AS (SELECT p.id, coalesce(sum(w.n), 0)::BIGINT AS n_descendant_paths FROM ped p LEFT JOIN paths w ON w.anc = p.id AND w.gen > 0 GROUP BY p.id),
da AS (SELECT p.id, count(DISTINCT w.anc) AS n_distinct_ancestors FROM ped p LEFT JOIN paths w ON w.id = p.id AND w.gen > 0 GROUP BY p.id),
fa AS (SELECT w.id, count(DISTINCT w.anc) AS n_founder_ancestors FROM paths w JOIN ped f ON f.id = w.anc AND f.mother IS NULL AND f.father IS NULL GROUP BY w.id),
eg AS (SELECT p.id, coalesce(sum(w.n * pow(2.0, -w.gen)), 0.0) AS ecg FROM ped p LEFT JOIN paths w ON w.id = p.id AND w.gen > 0 GROUP BY p.id)"""
_IND = """,
ind AS (SELECT p.id, p.sex, 'input' AS sex_source, p.mother, p.father, d.depth AS ped_depth, p.mother IS NULL AND p.father IS NULL AS is_founder, i.F, o.* EXCLUDE (id), c.component AS component_id, da.n_distinct_ancestors, dp.n_descendant_paths, fa.n_founder_ancestors, eg.ecg
  FROM ped p JOIN depth d USING (id) JOIN inbred i USING (id) JOIN onehop o USING (id) JOIN comp c USING (id) JOIN da USING (id) JOIN dp USING (id) JOIN fa USING (id) JOIN eg USING (id))"""


def _sql(body: str, *parts: str) -> str:
    return "WITH RECURSIVE" + _PED + "".join(parts) + "\n" + body


_ALL = (_WALKS, _SHARES, _INBRED, _PAIRS, _COMP, _ONE, _COUNTS, _IND)


def _dist(c: str) -> str:
    q = lambda p: f"round(quantile_cont({c}::DOUBLE, {p}), 8)"
    return (f"count({c}) AS n, round(avg({c}), 8) AS mean, round(CASE WHEN count({c}) > 1 THEN stddev_samp({c}) WHEN count({c}) = 1 THEN 0 END, 8) AS "
        f"std, round(min({c})::DOUBLE, 8) AS min, {q(0.25)} AS q1, {q(0.5)} AS median, {q(0.75)} AS q3, round(max({c})::DOUBLE, 8) AS max, count(*) "
        f"FILTER ({c} <> 0) AS nz")


def _eff(c: str) -> str:
    return f"round(coalesce(pow(sum({c}) FILTER ({c} > 0), 2) / sum({c}::DOUBLE * {c}) FILTER ({c} > 0), 0), 8)"


def _share(c: str) -> str:
    return f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 8)"


def _stacked(columns: tuple[str, ...]) -> str:
    union = " UNION ALL ".join(f"SELECT '{c}' AS variable, {c}::DOUBLE AS value FROM ind" for c in columns)
    return f"SELECT variable, {_dist('value')} FROM ({union}) GROUP BY variable"


def _stratum(by: str, name: str) -> str:
    return (f"SELECT {by} AS {name}, count(*) AS n, count(*) FILTER (is_founder) AS n_founders, count(*) FILTER (n_offspring > 0) AS n_reproductive, "
        f"round(avg(n_offspring), 8) AS mean_n_offspring, round(avg(n_mates), 8) AS mean_n_mates, round(avg(n_full_sibs), 8) AS mean_n_full_sibs, "
        f"round(avg(F), 8) AS mean_F, count(*) FILTER (F > 1e-9) AS n_inbred FROM ind GROUP BY 1")


def _related(most: int) -> str:
    """pairs classified to a degree: rel(id1, id2, code)."""
    wanted = [(k, c) for k, c in enumerate(CODES) if c[1] <= most]
    sides = sorted({(c[2], c[3]) for _, c in wanted if c[3]})
    fits = " OR ".join(f"(x.gen = {u} AND y.gen = {d})" for u, d in sides) or "false"
    top = max(c[2] for _, c in wanted)
    when = " ".join(f"WHEN u = {c[2]} AND d = {c[3]} AND ways >= {c[4]} THEN {k}" for k, c in wanted if c[0] not in ("MZ", "MO", "FO", "MHS", "PHS"))
    names = "[" + ", ".join(f"'{c[0]}'" for c in CODES) + "]"
    half = "".join(f" UNION ALL SELECT x.id, y.id, {k} FROM ped x JOIN ped y ON x.{r} = y.{r} AND x.id < y.id" for k, c in wanted for r in ({"MHS": "mother", "PHS": "father"}.get(c[0]),) if r)
    return f""",
near AS (SELECT * FROM paths WHERE gen BETWEEN 1 AND {top}),
ways AS (SELECT id AS i, anc AS j, gen AS u, 0 AS d, sum(n) AS ways FROM near GROUP BY ALL UNION ALL
  SELECT x.id, y.id, x.gen, y.gen, sum(x.n * y.n) FROM near x JOIN near y ON x.anc = y.anc AND x.id <> y.id AND ({fits}) AND (x.gen > y.gen OR x.id < y.id) GROUP BY ALL),
ranked AS (SELECT i, j, CASE {when} END AS rank FROM ways UNION ALL SELECT id, mother, 1 FROM ped WHERE mother IS NOT NULL UNION ALL SELECT id, father, 2 FROM ped WHERE father IS NOT NULL{half}),
rel AS (SELECT i AS id1, j AS id2, {names}[rank + 1] AS code FROM ranked WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY least(i, j), greatest(i, j) ORDER BY rank, i, j) = 1)"""


_DEGREE = "CASE code " + " ".join(f"WHEN '{c[0]}' THEN {c[1]}" for c in CODES) + " END"
_COHORT = """,
sums AS (SELECT d.depth AS cohort, s.anc, sum(s.l) AS s FROM shares s JOIN depth d USING (id) GROUP BY ALL),
tot AS (SELECT cohort, 0.5 * sum(s * s * i.D) AS total FROM sums JOIN inbred i ON i.id = sums.anc GROUP BY cohort),
own AS (SELECT d.depth AS cohort, count(*) AS size, avg(i.F) AS mean_F, sum((1 + i.F) / 2) AS selfs FROM depth d JOIN inbred i USING (id) GROUP BY 1),
coh AS (SELECT cohort, size, mean_F, total / (size * size) AS group_kinship, CASE WHEN size > 1 THEN (total - selfs) / (size * (size - 1)) END AS mean_kinship FROM own JOIN tot USING (cohort))"""


def _regressed(c: str) -> str:
    return f"""SELECT round(CASE WHEN slope < 0 THEN -1 / (2 * slope) END, 6) AS ne, round(slope, 6) AS slope, n AS n_cohorts, CASE WHEN n < 2 THEN 'too_few_cohorts' WHEN slope < 0 THEN NULL ELSE 'no_increase' END AS reason
FROM (SELECT regr_slope(ln(1 - {c}), cohort) AS slope, count(*) AS n FROM coh WHERE {c} IS NOT NULL AND cohort >= 1 AND {c} < 1)"""


_KIDS = """,
kid AS (SELECT parent, count(*) FILTER (p.sex = 'M') AS sons, count(*) FILTER (p.sex = 'F') AS daughters FROM edges e JOIN ped p ON p.id = e.child GROUP BY 1),
par AS (SELECT p.id, p.sex, coalesce(k.sons, 0)::DOUBLE AS sons, coalesce(k.daughters, 0)::DOUBLE AS daughters FROM ped p LEFT JOIN kid k ON k.parent = p.id)"""


def _family(by: str, source: str) -> str:
    cols = ", ".join((f"count(*) FILTER (sex = '{s}') AS n_{p}, sum(sons) FILTER (sex = '{s}') AS s_{p}, sum(daughters) FILTER (sex = '{s}') AS t_{p}, avg(sons) "
        f"FILTER (sex = '{s}') AS k_{p}m, avg(daughters) FILTER (sex = '{s}') AS k_{p}f, var_samp(sons) FILTER (sex = '{s}') AS v_{p}m, "
        f"var_samp(daughters) FILTER (sex = '{s}') AS v_{p}f, covar_samp(sons, daughters) FILTER (sex = '{s}') AS c_{p}") for p, s in (("m", "M"), ("f", "F")))
    rel = ", ".join((f"CASE WHEN k_{p}m > 0 AND k_{p}f > 0 THEN v_{p}m / (k_{p}m * k_{p}m) + v_{p}f / (k_{p}f * k_{p}f) + 2 * c_{p} / (k_{p}m * k_{p}f) END AS "
        f"v{p}") for p in ("m", "f"))
    return f"(SELECT *, {rel} FROM (SELECT {by}, {cols} FROM {source} GROUP BY 1))"


_DATED = ",\ndated AS (SELECT p.*, d.depth, (1900 + 25 * d.depth + p.id % 20)::INT AS birth_year FROM ped p JOIN depth d USING (id))"
_BIRTHS = """,
born AS (SELECT *, date '1950-01-01' + (((id // 4) % 300) * 3 + (id % 4) * (id % 3) * 4)::INT AS birth_date FROM dated),
gaps AS (SELECT *, birth_date - lag(birth_date) OVER w AS gap FROM born WHERE mother IS NOT NULL AND father IS NOT NULL WINDOW w AS (PARTITION BY mother, father ORDER BY birth_date, id)),
sess AS (SELECT *, sum(CASE WHEN gap <= 7 THEN 0 ELSE 1 END) OVER (PARTITION BY mother, father ORDER BY birth_date, id ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
sets AS (SELECT mother, father, session, row_number() OVER (ORDER BY mother, father, min(birth_date)) AS set FROM sess GROUP BY mother, father, session HAVING count(*) >= 2),
member AS (SELECT s.id, t.set FROM sess s JOIN sets t USING (mother, father, session)),
settab AS (SELECT m.set, count(*) AS size, count(*) FILTER (sex = 'M') AS males, count(*) FILTER (sex = 'F') AS females, (min(birth_year) // 10 * 10)::INT AS decade FROM member m JOIN born b USING (id) GROUP BY m.set)"""
_DIRTY = _PED + """,
src AS (SELECT id, CASE WHEN id % 31 = 5 THEN NULL WHEN id % 43 = 7 THEN CASE WHEN sex = 'F' THEN 'M' ELSE 'F' END ELSE sex END AS sex,
  CASE WHEN id % 53 = 9 THEN (9 * 10000000 + 1000000 + id)::BIGINT ELSE mother END AS mother, CASE WHEN id % 59 = 11 THEN NULL ELSE father END AS father,
  CASE WHEN id % 61 = 3 THEN 2500 WHEN id % 67 = 4 THEN NULL ELSE (1900 + id // 40)::INT END AS birth_year, 2 * id AS row FROM ped),
lnk AS (SELECT id, 'mother' AS role, mother AS parent FROM src WHERE mother IS NOT NULL UNION ALL SELECT id, 'father', father FROM src WHERE father IS NOT NULL),
roles AS (SELECT parent AS id, bool_or(role = 'mother') AS m, bool_or(role = 'father') AS f FROM lnk GROUP BY 1),
gone AS (SELECT parent, role, count(*) AS n_refs FROM lnk WHERE parent NOT IN (SELECT id FROM src) GROUP BY ALL),
typed AS (SELECT s.*, CASE WHEN r.m AND NOT r.f THEN 'F' WHEN r.f AND NOT r.m THEN 'M' END AS role FROM src s LEFT JOIN roles r USING (id)),
imp AS (SELECT *, coalesce(role, sex) AS now, CASE WHEN sex IS NULL AND role IS NOT NULL THEN 'imputed_from_missing' WHEN sex IS NULL THEN 'unresolved' WHEN sex <> role THEN 'imputed_from_role' ELSE 'input' END AS sex_source FROM typed)"""
DIRTY = _DIRTY
_MATES = _PAIRS + """,
trait AS (SELECT id, acctbal AS x, CASE WHEN acctbal > 4000 THEN 1.0 ELSE 0.0 END::DOUBLE AS b, floor(acctbal / 3000)::DOUBLE AS o FROM ped),
mv AS (SELECT q.mother, q.father, m.x AS m_x, f.x AS f_x, m.b AS m_b, f.b AS f_b, m.o AS m_o, f.o AS f_o FROM pairs q JOIN trait m ON m.id = q.mother JOIN trait f ON f.id = q.father)"""
_TWO = ("SELECT *, CASE WHEN n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0 THEN round(n00 * n11 / (n01 * n10)::DOUBLE, 8) END AS odds_ratio, CASE WHEN "
    "n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0 THEN round(sqrt(1.0::DOUBLE / n00 + 1.0::DOUBLE / n01 + 1.0::DOUBLE / n10 + 1.0::DOUBLE / n11), "
    "8) END AS se_log_odds, CASE WHEN n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0 THEN round(exp(ln(n00 * n11 / (n01 * n10)::DOUBLE) - "
    "1.959963984540054 * sqrt(1.0::DOUBLE / n00 + 1.0::DOUBLE / n01 + 1.0::DOUBLE / n10 + 1.0::DOUBLE / n11)), 8) END AS odds_ratio_low, CASE "
    "WHEN n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0 THEN round(exp(ln(n00 * n11 / (n01 * n10)::DOUBLE) + 1.959963984540054 * sqrt(1.0::DOUBLE "
    "/ n00 + 1.0::DOUBLE / n01 + 1.0::DOUBLE / n10 + 1.0::DOUBLE / n11)), 8) END AS odds_ratio_high, round((n00 * n11 - n01 * n10) / sqrt((n00 + "
    "n01)::DOUBLE * (n10 + n11) * (n00 + n10) * (n01 + n11)), 8) AS phi")
_FOUNDER = (",\nreach AS (SELECT DISTINCT w.id, w.anc, d.depth FROM paths w JOIN ped f ON f.id = w.anc AND f.mother IS NULL AND f.father IS NULL JOIN "
    "depth d ON d.id = w.id)")
_KINDMAP = (",\nkindmap AS (SELECT * FROM (VALUES ('MO', 'PO', 0.25), ('FO', 'PO', 0.25), ('FS', 'FS', 0.25), ('MHS', 'HS', 0.125), ('PHS', 'HS', "
    "0.125), ('MHS', 'mHS', 0.125), ('PHS', 'pHS', 0.125), ('Av', 'Av', 0.125), ('GP', '1G', 0.125), ('1C', '1C', 0.0625)) t(code, kind, "
    "kinship)),\nrelk AS (SELECT id1, id2, kind, kinship::DOUBLE AS kinship FROM rel JOIN kindmap USING (code)),\nside AS (SELECT kind, id1 AS "
    "id FROM relk UNION ALL SELECT kind, id2 FROM relk WHERE kind NOT IN ('PO', 'Av', '1G')),\nskel AS (SELECT k.kind, p.id, CASE WHEN p.sex = "
    "'M' THEN 1 ELSE 2 END AS sex, p.birth_year AS born_at_year, (SELECT count(*) FROM side s WHERE s.kind = k.kind AND s.id = p.id)::INT AS "
    "n_relatives FROM dated p CROSS JOIN (SELECT DISTINCT kind FROM kindmap) k)")
_GROUP = lambda keys: (f"SELECT size, males, count(*) AS n FROM (SELECT count(*) AS size, count(*) FILTER (sex = 'M') AS males FROM ped WHERE "
    f"{' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)} HAVING count(*) >= 2) GROUP BY ALL")  # noqa: E731

ORACLES: dict[str, str] = {
    "structural_depth": _sql("SELECT id, depth FROM depth", _WALKS),
    "parent_child_edges": _sql("SELECT * FROM edges"),
    "ancestor_closure": _sql("SELECT * FROM paths", _WALKS),
    "connected_components": _sql("SELECT id, component FROM comp", _COMP),
    "mate_networks": _sql(", und AS (SELECT mother AS a, father AS b FROM pairs UNION SELECT father, mother FROM pairs), cc AS (SELECT DISTINCT a AS id, a AS c FROM "
        "und UNION SELECT u.b, cc.c FROM cc JOIN und u ON u.a = cc.id WHERE cc.c < u.b) SELECT id, min(c) AS network FROM cc GROUP BY id", _PAIRS),
    "one_hop_relative_counts": _sql("SELECT * FROM onehop", _PAIRS, _ONE),
    "offspring_count": _sql("SELECT parent AS id, count(*) AS n_offspring FROM edges GROUP BY 1"),
    "mating_pair_table": _sql("SELECT * FROM pairs", _PAIRS),
    "individual_table": _sql("SELECT * REPLACE (round(F, 8) AS F, round(ecg, 8) AS ecg) FROM ind", *_ALL),
    "descendant_path_counts": _sql("SELECT * FROM dp", _WALKS, _COUNTS),
    "distinct_ancestor_counts": _sql("SELECT * FROM da", _WALKS, _COUNTS),
    "founder_ancestor_counts": _sql("SELECT p.id, coalesce(f.n_founder_ancestors, 0) AS n_founder_ancestors FROM ped p LEFT JOIN fa f USING (id)", _WALKS, _COUNTS),
    "equivalent_complete_generations": _sql("SELECT id, round(ecg, 8) AS ecg FROM eg", _WALKS, _COUNTS),
    "inbreeding_coefficients": _sql("SELECT id, round(F, 8) AS F, round(D, 8) AS D FROM inbred", _WALKS, _SHARES, _INBRED),
    "mating_pair_kinship": _sql("SELECT q.mother AS id1, q.father AS id2, round(coalesce(0.5 * sum(a.l * b.l * i.D), 0), 8) AS kinship FROM pairs q LEFT JOIN shares a ON "
        "a.id = q.mother LEFT JOIN shares b ON b.id = q.father AND b.anc = a.anc LEFT JOIN inbred i ON i.id = b.anc GROUP BY ALL", _WALKS, _SHARES, _INBRED, _PAIRS),
    "mean_kinship_by_depth": _sql("SELECT cohort, size, round(mean_F, 8) AS mean_F, round(group_kinship, 8) AS group_kinship, round(mean_kinship, 8) AS mean_kinship FROM coh", _WALKS, _SHARES, _INBRED, _COHORT),
    "numeric_distribution": _sql(_stacked(("n_offspring", "n_full_sibs", "n_descendant_paths", "ecg", "F")), *_ALL),
    "size_structure": _sql(
        """SELECT a.*, b.*, c.* FROM (SELECT count(*) AS n_individuals, count(*) FILTER (sex = 'F') AS n_females, count(*) FILTER (sex = 'M') AS n_males, count(*) FILTER (sex IS NULL) AS n_unknown_sex,
count(*) FILTER (mother IS NULL AND father IS NULL) AS n_founders, count(*) FILTER (mother IS NOT NULL OR father IS NOT NULL) AS n_nonfounders, count(mother) AS n_mother_links, count(father) AS n_father_links,
count(*) FILTER (mother IS NOT NULL AND father IS NOT NULL) AS n_both_parents, count(*) FILTER ((mother IS NULL) <> (father IS NULL)) AS n_one_parent, count(*) FILTER (mother IS NOT NULL AND father IS NULL) AS n_mother_only, count(*) FILTER (mother IS NULL AND father IS NOT NULL) AS n_father_only FROM ped) a,
(SELECT max(depth) AS max_depth, round(avg(depth), 8) AS mean_depth, round(quantile_cont(depth::DOUBLE, 0.5), 8) AS median_depth, count(DISTINCT depth) AS n_depths FROM depth) b,
(SELECT count(*) AS n_components, max(size) AS largest_component, count(*) FILTER (size = 1) AS n_singletons, round(avg(size), 8) AS mean_component FROM (SELECT component, count(*) AS size FROM comp GROUP BY 1)) c""",
        _WALKS,
        _COMP,
    ),
    "depth_counts": _sql("SELECT depth, count(*) AS n FROM depth GROUP BY 1", _WALKS),
    "largest_components": _sql("SELECT component, count(*) AS size FROM comp GROUP BY 1 ORDER BY size DESC, component LIMIT 6", _COMP),
    "mating_pair_summary": _sql(f"SELECT count(*) FILTER (n_offspring > 1) AS n_multi_child_pairs, {_eff('n_offspring')} AS effective_pairs, {_dist('n_offspring')} FROM "
        f"pairs", _PAIRS),
    "sibship_sizes": _sql(f"SELECT count(*) AS n_sibships, round(avg(n_offspring), 8) AS mean, round(quantile_cont(n_offspring::DOUBLE, 0.5), 8) AS median, "
        f"round(quantile_cont(n_offspring::DOUBLE, 0.25), 8) AS q1, round(quantile_cont(n_offspring::DOUBLE, 0.75), 8) AS q3, "
        f"{', '.join(f'{_share(f'n_offspring = {k}')} AS share_{k}' for k in (1, 2, 3))}, {_share('n_offspring >= 4')} AS share_4plus FROM pairs", _PAIRS),
    "reproduction_counts": _sql(f"SELECT stratum, count(*) AS n, count(*) FILTER (n_offspring > 0) AS n_reproductive, count(*) FILTER (n_offspring = 0) AS n_terminal, "
        f"round(avg(CASE WHEN mother IS NOT NULL AND father IS NOT NULL THEN (n_full_sibs > 0)::INT::DOUBLE END), 8) AS full_sib_fraction, "
        f"round(avg(n_offspring), 8) AS mean_offspring, round(avg(n_mates), 8) AS mean_mates, "
        f"{', '.join(f'{_share(f'n_offspring = {k}')} AS offspring_{k}' for k in range(4))}, {_share('n_offspring >= 4')} AS offspring_4plus FROM "
        f"(SELECT *, 'all' AS stratum FROM ind UNION ALL SELECT *, sex FROM ind) GROUP BY stratum", *_ALL),
    "genealogy_distributions": _sql(_stacked(("n_descendant_paths", "n_distinct_ancestors")), *_ALL),
    "founder_contribution": _sql(f"SELECT count(*) FILTER (n_descendant_paths > 0) AS n_with_descendants, count(*) FILTER (n_descendant_paths = 0) AS n_without_descendants, "
        f"{_eff('n_descendant_paths')} AS effective_founders, {_dist('n_descendant_paths')} FROM ind WHERE is_founder", *_ALL),
    "founder_summary_by_depth": _sql(f"SELECT a.depth, a.n, b.active_founders, b.effective_founders, a.mean_founder_ancestors FROM (SELECT depth, count(*) AS n, round(avg(k), 8) "
        f"AS mean_founder_ancestors FROM (SELECT depth, id, count(*) AS k FROM reach GROUP BY ALL) GROUP BY depth) a JOIN (SELECT depth, count(*) AS "
        f"active_founders, {_eff('d')} AS effective_founders FROM (SELECT depth, anc, count(*) AS d FROM reach GROUP BY ALL) GROUP BY depth) b USING "
        f"(depth)", _WALKS, _FOUNDER),
    "component_summary": _sql(f"SELECT {_share('size = 1')} AS share_1, {_share('size = 2')} AS share_2, {_share('size BETWEEN 3 AND 9')} AS share_3_9, "
        f"{_share('size BETWEEN 10 AND 99')} AS share_10_99, {_share('size >= 100')} AS share_100plus, {_dist('size')} FROM (SELECT count(*) AS size "
        f"FROM comp GROUP BY component)", _COMP),
    "sex_summary": _sql(_stratum("sex", "sex"), *_ALL),
    "depth_summary": _sql(_stratum("ped_depth", "ped_depth"), *_ALL),
    "inbreeding_summary": _sql(f"SELECT count(*) FILTER (F > 1e-9) AS n_inbred, {_share('F > 1e-9')} AS fraction, round(avg(F), 8) AS mean, round(avg(F) FILTER (F > 1e-9), "
        f"8) AS mean_inbred, round(max(F), 8) AS max FROM inbred", _WALKS, _SHARES, _INBRED),
    "inbreeding_histogram": _sql("SELECT CASE WHEN F <= 1e-9 THEN '0' WHEN F <= 0.0625 THEN '(0, 0.0625]' WHEN F <= 0.125 THEN '(0.0625, 0.125]' WHEN F <= 0.25 THEN '(0.125, "
        "0.25]' ELSE '(0.25, 1]' END AS bin, count(*) AS n FROM inbred GROUP BY 1", _WALKS, _SHARES, _INBRED),
    "family_support": _sql("SELECT sex, count(DISTINCT CASE WHEN mother IS NULL AND father IS NULL THEN 'i' || id ELSE 'f' || coalesce(mother::VARCHAR, '') || '/' || "
        "coalesce(father::VARCHAR, '') END) AS units FROM ped GROUP BY sex"),
    "contingency_table": _sql("SELECT sex, segment, count(*) AS n FROM ped GROUP BY ALL"),
    "relationship_pairs": _sql("SELECT * FROM rel", _WALKS, _related(2)),
    "relationship_counts": _sql("SELECT code, count(*) AS n FROM rel GROUP BY code", _WALKS, _related(5)),
    "relationship_burden": _sql(f"SELECT p.id, {', '.join(f'count(*) FILTER (degree = {k}) AS degree_{k}' for k in range(1, 6))}, min(degree) AS closest_degree FROM ped p "
        f"LEFT JOIN (SELECT id1 AS id, {_DEGREE} AS degree FROM rel UNION ALL SELECT id2, {_DEGREE} FROM rel) r USING (id) GROUP BY p.id", _WALKS, _related(5)),
    "related_density_by_depth": _sql("SELECT depth, n, n_pairs, CASE WHEN n > 1 THEN round(n_pairs / (n * (n - 1) / 2::DOUBLE), 8) END AS density FROM (SELECT d.depth, count(*) "
        "AS n, (SELECT count(*) FROM rel JOIN depth a ON a.id = id1 JOIN depth b ON b.id = id2 WHERE a.depth = d.depth AND b.depth = d.depth) AS "
        "n_pairs FROM depth d GROUP BY d.depth)", _WALKS, _related(5)),
    "ne_inbreeding": _sql(_regressed("mean_F"), _WALKS, _SHARES, _INBRED, _COHORT),
    "ne_coancestry": _sql(_regressed("mean_kinship"), _WALKS, _SHARES, _INBRED, _COHORT),
    "ne_group_coancestry": _sql(_regressed("group_kinship"), _WALKS, _SHARES, _INBRED, _COHORT),
    "ne_sex_ratio": _sql("SELECT round(count(ne) / sum(1 / ne), 6) AS ne, count(ne) AS n_cohorts FROM (SELECT 4.0::DOUBLE * count(*) FILTER (sex = 'M') * count(*) "
        "FILTER (sex = 'F') / count(*) AS ne FROM ped JOIN depth USING (id) GROUP BY depth)", _WALKS),
    "ne_variance_family_size": _sql(f"SELECT depth, n_m AS males, n_f AS females, round(vm, 6) AS vm, round(vf, 6) AS vf, round(CASE WHEN s_m > 0 AND t_m > 0 THEN 1 / (1 / (8 * "
        f"s_m) + 1 / (8 * t_m) + vm / (16 * n_m) + vf / (16 * n_f)) END, 6) AS ne FROM {_family('depth', 'par JOIN depth USING (id)')}", _WALKS, _KIDS),
    "ne_individual_delta_f": _sql("SELECT CASE WHEN m > 0 THEN round(1 / (2 * m), 6) END AS ne, CASE WHEN m > 0 THEN round(2 * (1 / (2 * m)) * (1 / (2 * m)) * sd / sqrt(n), "
        "6) END AS se, CASE WHEN u > 0 THEN round(1 / (2 * u), 6) END AS ne_unrelated_founders, n AS n_reference, CASE WHEN n = 0 THEN "
        "'empty_reference' WHEN m > 0 THEN NULL ELSE 'no_increase' END AS reason FROM (SELECT avg(d) AS m, stddev_samp(d) AS sd, count(d) AS n, "
        "avg(v) AS u FROM (SELECT CASE WHEN ecg > 0 THEN 1 - pow(1 - F, 1 / ecg) END AS d, CASE WHEN ecg > 1 THEN 1 - pow(1 - F, 1 / (ecg - 1)) END "
        "AS v FROM inbred JOIN eg USING (id) JOIN depth USING (id) WHERE depth = (SELECT max(depth) FROM depth)))", _WALKS, _SHARES, _INBRED, _COUNTS),
    "ne_long_term_contributions": _sql(", con AS (SELECT d.depth, s.anc, sum(s.l) / (SELECT count(*) FROM depth e WHERE e.depth = d.depth) AS c FROM shares s JOIN depth d USING "
        "(id) JOIN ped f ON f.id = s.anc AND f.mother IS NULL GROUP BY d.depth, s.anc), lst AS (SELECT max(depth) AS last FROM depth), wide AS "
        "(SELECT anc, sum(CASE WHEN depth = last THEN c ELSE 0 END) AS now, sum(CASE WHEN depth = last - 1 THEN c ELSE 0 END) AS before FROM con, "
        "lst WHERE depth >= last - 1 GROUP BY anc) SELECT round(2 / sum(now * now), 8) AS ne, round(sum(now * now), 8) AS sum_c2, round(max(abs(now "
        "- before)), 8) AS max_delta_final, NULL::VARCHAR AS reason FROM wide", _WALKS, _SHARES),
    "ne_hill_overlapping": _sql(f", ages AS (SELECT role, c.birth_year - p.birth_year AS age FROM edges e JOIN dated c ON c.id = e.child JOIN dated p ON p.id = e.parent), "
        f"life AS (SELECT (avg(age) FILTER (role = 'father') + avg(age) FILTER (role = 'mother')) / 2 AS L, quantile_cont(age::DOUBLE, 0.95) AS late "
        f"FROM ages), fam AS {_family('birth_year', 'par JOIN dated USING (id)').replace('sex', 'par.sex')}, part AS (SELECT birth_year, L, CASE WHEN "
        f"s_m > 0 AND t_m > 0 THEN (1 / s_m + 1 / t_m) / 16 + vm / (16 * n_m) END AS pm, CASE WHEN s_f > 0 AND t_f > 0 THEN (1 / s_f + 1 / t_f) / 16 "
        f"+ vf / (16 * n_f) END AS pf FROM fam, life WHERE birth_year <= (SELECT max(birth_year) FROM dated) - late) SELECT birth_year, round(CASE "
        f"WHEN pm + pf > 0 THEN L / (pm + pf) END, 6) AS ne, round(CASE WHEN pm > 0 THEN L / (4 * pm) END, 6) AS ne_m, round(CASE WHEN pf > 0 THEN L "
        f"/ (4 * pf) END, 6) AS ne_f, round(L, 6) AS L FROM part", _WALKS, _KIDS, _DATED),
    "sex_concordance_groups": _sql(_GROUP(("mother", "father"))),
    "sex_concordance_by_size": _sql(f"SELECT size, sum(n)::BIGINT AS n_groups, sum(males * n)::BIGINT AS n_males, sum((males * (males - 1) + (size - males) * (size - males - 1)) "
        f"// 2 * n)::BIGINT AS concordant_pairs FROM ({_GROUP(('mother',))}) GROUP BY size"),
    "sex_concordance_sums": _sql(f"SELECT sum(n)::BIGINT AS n_groups, sum(size * (size - 1) // 2 * n)::BIGINT AS pairs, sum(size * (size - 1) * (size - 2) * n)::BIGINT AS "
        f"triples, sum(size * n)::BIGINT AS members, sum(males * n)::BIGINT AS males, sum((males * (males - 1) // 2 + (size - males) * (size - males "
        f"- 1) // 2) * n)::BIGINT AS concordant FROM ({_GROUP(('father',))})"),
    "multiple_birth_sets": _sql("SELECT id, set::INT AS set FROM member", _WALKS, _DATED, _BIRTHS),
    "multiple_births_by_size": _sql("SELECT size, count(*) AS n_sets, 1.0::DOUBLE AS full_sib_fraction FROM settab GROUP BY size", _WALKS, _DATED, _BIRTHS),
    "twin_pairs_by_sex": _sql("SELECT *, least(2 * mf, mm + ff + mf) AS dizygotic, mm + ff + mf - least(2 * mf, mm + ff + mf) AS monozygotic FROM (SELECT decade, count(*) "
        "FILTER (males = 2) AS mm, count(*) FILTER (females = 2) AS ff, count(*) FILTER (males = 1 AND females = 1) AS mf, 0::BIGINT AS unknown FROM "
        "settab WHERE size = 2 GROUP BY decade)", _WALKS, _DATED, _BIRTHS),
    "relative_pairs": _sql("SELECT * FROM relk WHERE kind IN ('FS', 'HS', 'Av', '1C')", _WALKS, _related(3), _DATED, _KINDMAP),
    "relatives_skeleton": _sql("SELECT * FROM skel", _WALKS, _related(3), _DATED, _KINDMAP),
    "relationship_diagnostics": _sql("SELECT kind, count(*) FILTER (n_relatives > 0) AS n_with_relative, round(avg(n_relatives) FILTER (n_relatives > 0), 8) AS mean_among_them "
        "FROM skel GROUP BY kind", _WALKS, _related(3), _DATED, _KINDMAP),
    "lineage_avuncular": _sql("SELECT DISTINCT c.id AS id1, s.id AS id2 FROM ped c JOIN ped m ON m.id = c.mother JOIN ped s ON s.mother = m.mother AND s.father = m.father "
        "AND s.id <> m.id LEFT JOIN kin k ON k.mother = c.mother AND k.father = c.father WHERE c.father IS NULL OR coalesce(k.kinship, 0) < 0.0625", _WALKS, _SHARES, _INBRED, _PAIRS, ",\nkin AS (SELECT q.mother, q.father, 0.5 * sum(a.l * b.l * i.D) AS kinship FROM pairs q JOIN shares a ON a.id = q.mother JOIN shares b ON "
        "b.id = q.father AND b.anc = a.anc JOIN inbred i ON i.id = b.anc GROUP BY ALL)"),
    "sex_imputation": "WITH" + _DIRTY + " SELECT id, now AS sex, sex_source FROM imp",
    "synthesized_founders": "WITH" + _DIRTY + " SELECT parent AS id, CASE WHEN bool_or(role = 'mother') AND bool_or(role = 'father') THEN NULL WHEN bool_or(role = 'mother') THEN 'F' ELSE "
        "'M' END AS sex FROM gone GROUP BY parent",
    "phantom_parents": "WITH" + _DIRTY + ", half AS (SELECT id, row_number() OVER (ORDER BY row) + (SELECT max(greatest(id, coalesce(mother, id), coalesce(father, id))) FROM src) AS "
        "new FROM src WHERE (mother IS NULL) <> (father IS NULL)) SELECT s.id, coalesce(s.mother, h.new) AS mother, coalesce(s.father, h.new) AS "
        "father FROM src s LEFT JOIN half h USING (id)",
    "fixed_pedigree": "WITH RECURSIVE" + _DIRTY + ", whole AS (SELECT id, now AS sex, sex_source, mother, father FROM imp UNION ALL SELECT parent, CASE WHEN bool_or(role = 'mother') AND "
        "bool_or(role = 'father') THEN NULL WHEN bool_or(role = 'mother') THEN 'F' ELSE 'M' END, CASE WHEN bool_or(role = 'mother') AND bool_or(role "
        "= 'father') THEN 'unresolved' ELSE 'imputed_from_missing' END, NULL, NULL FROM gone GROUP BY parent), up AS (SELECT id, id AS anc, 0 AS gen "
        "FROM whole UNION SELECT u.id, p.parent, u.gen + 1 FROM up u JOIN (SELECT id, mother AS parent FROM whole UNION ALL SELECT id, father FROM "
        "whole) p ON p.id = u.anc WHERE p.parent IS NOT NULL) SELECT w.*, d.ped_depth FROM whole w JOIN (SELECT id, max(gen) AS ped_depth FROM up "
        "GROUP BY id) d USING (id)",
    "validation_findings": "WITH" + _DIRTY + """, yr AS (SELECT c.id, c.birth_year - p.birth_year AS age FROM lnk l JOIN src c ON c.id = l.id JOIN src p ON p.id = l.parent WHERE c.birth_year IS NOT NULL AND p.birth_year IS NOT NULL),
tw AS (SELECT id // 100 AS s, id, sex, mother, father, birth_year FROM (SELECT i.id, i.now AS sex, i.mother, i.father, i.birth_year FROM imp i) WHERE id >= 48 AND id % 100 < 2),
ts AS (SELECT s, count(*) AS k, count(DISTINCT mother) AS ms, count(DISTINCT father) AS fs, count(*) FILTER (mother IS NULL AND father IS NULL) AS orphans, count(DISTINCT birth_year) AS years FROM tw GROUP BY s),
bad AS (SELECT s FROM ts WHERE k < 2 OR ms > 1 OR fs > 1 OR (orphans > 0 AND orphans < k) OR years > 1),
mz AS (SELECT tw.*, count(*) OVER (PARTITION BY s) AS k, count(DISTINCT sex) OVER (PARTITION BY s) AS sexes, s IN (SELECT s FROM bad) AS out FROM tw),
f AS (SELECT 'duplicate_rows' AS "check", 0::BIGINT AS n_refs FROM src WHERE id % 97 = 2
UNION ALL SELECT 'parent_refs_present_' || role, n_refs FROM gone
UNION ALL SELECT 'parent_child_count', k FROM (SELECT parent, role, count(*) AS k FROM lnk GROUP BY ALL HAVING count(*) > 10)
UNION ALL SELECT 'sex_role_ambiguity', 0 FROM src s JOIN roles r USING (id) WHERE r.m AND r.f AND s.sex IS NULL
UNION ALL SELECT 'parent_role_conflict', 0 FROM src s JOIN roles r USING (id) WHERE r.m AND r.f AND s.sex IS NOT NULL
UNION ALL SELECT 'parent_refs_sex_conflict', sum(n_refs) FROM gone GROUP BY parent HAVING count(*) = 2
UNION ALL SELECT 'sex_role_override', 0 FROM imp WHERE sex_source = 'imputed_from_role'
UNION ALL SELECT 'birth_year_range', 0 FROM src WHERE birth_year NOT BETWEEN 1800 AND 2026
UNION ALL SELECT 'birth_year_topology', 0 FROM yr WHERE age < 12 OR age > 81
UNION ALL SELECT 'multiple_birth_sets', 0 FROM tw WHERE s IN (SELECT s FROM bad)
UNION ALL SELECT 'mz_links', 0 FROM mz WHERE out OR k <> 2 OR sexes > 1)
SELECT c.name AS "check", CASE WHEN c.skip THEN 'SKIP' WHEN f.n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, coalesce(f.n, 0)::BIGINT AS n, coalesce(f.n_refs, 0)::BIGINT AS n_refs
FROM (VALUES """ + ", ".join(f"('{c.name}', {str(c.name in _OFF).lower()})" for c in CHECKS) + """) c(name, skip) LEFT JOIN (SELECT "check", count(*) AS n, sum(n_refs) AS n_refs FROM f GROUP BY 1) f ON f."check" = c.name""",
    "mate_values": _sql("SELECT * FROM mv", _MATES),
    "mate_pearson": _sql("SELECT count(*) AS n, round(corr(m_x, f_x), 8) AS r FROM mv", _MATES),
    "mate_spearman": _sql(", rk AS (SELECT rank() OVER (ORDER BY m_x) + (count(*) OVER (PARTITION BY m_x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY f_o) + "
        "(count(*) OVER (PARTITION BY f_o) - 1) / 2.0::DOUBLE AS ry FROM mv) SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho FROM rk", _MATES),
    "mate_table_2x2": _sql(_TWO + " FROM (SELECT count(*) FILTER (m_b = 0 AND f_b = 0) AS n00, count(*) FILTER (m_b = 0 AND f_b > 0) AS n01, count(*) FILTER (m_b > 0 AND f_b "
        "= 0) AS n10, count(*) FILTER (m_b > 0 AND f_b > 0) AS n11 FROM mv)", _MATES),
    "mate_point_biserial": _sql("SELECT count(*) AS n, round(corr(m_x, f_b), 8) AS r FROM mv", _MATES),
    "mate_contingency": _sql("SELECT m_o AS x, f_o AS y, count(*) AS n FROM mv GROUP BY ALL", _MATES),
    "trait_levels": _sql("SELECT level, n, (row_number() OVER (ORDER BY level) - 1)::INT AS code FROM (SELECT lower(segment) AS level, count(*) AS n FROM ped GROUP "
        "BY 1)"),
    "mate_strata": _sql("SELECT q.mother, q.father, (m.birth_year // 10 * 10)::INT AS mother_stratum, (f.birth_year // 10 * 10)::INT AS father_stratum FROM pairs q "
        "JOIN dated m ON m.id = q.mother JOIN dated f ON f.id = q.father", _WALKS, _DATED, _PAIRS),
}

# The pedigree with half-founders, unknown sexes and linked twins -------------------------------------------------------

_PART = _PED.replace("\nped AS", "\nfull_ped AS").replace("edges AS", """ped AS (SELECT id, CASE WHEN id % 23 <> 7 THEN sex END AS sex, CASE WHEN id % 17 <> 3 THEN mother END AS mother,
  CASE WHEN id % 19 <> 5 THEN father END AS father, acctbal, segment FROM full_ped),
edges AS""")
_TWINS = "SELECT id, id + 2, 0 FROM ped WHERE id >= 48 AND id % 40 = 0 AND id + 2 IN (SELECT id FROM ped)"


def _partial(name: str, twins: bool = False) -> str:
    """The SQL of a query, over the other pedigree."""
    out = ORACLES[name].replace(_PED, _PART)
    if _PART not in out:
        raise ValueError(name)
    return out.replace("SELECT id, mother, 1 FROM ped", _TWINS + " UNION ALL SELECT id, mother, 1 FROM ped") if twins else out


PARTIAL = {
    name: (f"partial_{name}", twins)
    for twins, names in (
        (False, ("individual_table", "one_hop_relative_counts", "size_structure", "equivalent_complete_generations", "inbreeding_coefficients", "mating_pair_kinship", "mean_kinship_by_depth", "family_support", "sex_summary", "founder_summary_by_depth", "founder_contribution")),
        (True, ("relationship_pairs", "relationship_counts", "relationship_burden", "related_density_by_depth")),
    )
    for name in names
}
ORACLES |= {to: _partial(name, twins) for name, (to, twins) in PARTIAL.items()}
ORACLES["partial_individual_table"] = ORACLES["partial_individual_table"].replace("'input' AS sex_source", "CASE WHEN p.sex IS NULL THEN 'unresolved' ELSE 'input' END AS sex_source")
ORACLES["partial_sex_summary"] = ORACLES["partial_sex_summary"].replace("SELECT sex AS sex", "SELECT coalesce(sex, 'unknown') AS sex")
# Pair lists to the fifth degree, where all codes occur.
ORACLES["partial_relationship_pairs"] = _sql("SELECT * FROM rel", _WALKS, _related(5)).replace(_PED, _PART).replace("SELECT id, mother, 1 FROM ped", _TWINS + " UNION ALL SELECT id, mother, 1 FROM ped")

# Gates of safe output ----------------------------------------------------------------------------------------------------

_GATED = """,
cop AS (SELECT id + 2 AS id FROM ped WHERE id >= 48 AND id % 40 = 0 AND id + 2 IN (SELECT id FROM ped)),
who AS (SELECT p.*, d.depth, i.F, g.ecg, p.id IN (SELECT id FROM cop) AS copy, p.id IN (SELECT mother FROM ped WHERE mother IS NOT NULL) AS is_m, p.id IN (SELECT father FROM ped WHERE father IS NOT NULL) AS is_f,
  d.depth = (SELECT max(depth) FROM depth) AS ref, b.birth_year FROM ped p JOIN depth d USING (id) JOIN inbred i USING (id) JOIN eg g USING (id) JOIN dated b USING (id)),
byd AS (SELECT depth, count(*) AS n, count(*) FILTER (NOT copy) AS genomes, count(*) FILTER (copy) AS copies, count(*) FILTER (sex = 'M') AS male, count(*) FILTER (sex = 'F') AS female, count(*) FILTER (sex = 'M' AND is_f) AS fathers,
  count(*) FILTER (sex = 'F' AND is_m) AS mothers, count(*) FILTER (F > 1e-9) AS inb, count(*) FILTER (ecg > 0) AS used FROM who GROUP BY depth),
genome AS (SELECT *, CASE WHEN mother IS NULL AND father IS NULL THEN 'i' || id ELSE 'f' || coalesce(mother::VARCHAR, '-') || '/' || coalesce(father::VARCHAR, '-') END AS family FROM who WHERE NOT copy),
sm AS (SELECT mother AS parent, depth FROM genome WHERE mother IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
sf AS (SELECT father AS parent, depth FROM genome WHERE father IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
sib AS (SELECT depth, family FROM genome WHERE (mother, depth) IN (SELECT parent, depth FROM sm) OR (father, depth) IN (SELECT parent, depth FROM sf)),
fams AS (SELECT depth, count(DISTINCT family) AS families FROM sib GROUP BY 1),
shar AS (SELECT depth, count(*) AS shared FROM (SELECT depth FROM sm UNION ALL SELECT depth FROM sf) GROUP BY 1),
ages AS (SELECT role, c.id, c.birth_year - p.birth_year AS age, e.parent FROM edges e JOIN who c ON c.id = e.child JOIN who p ON p.id = e.parent),
hill AS (SELECT DISTINCT birth_year FROM who WHERE birth_year <= (SELECT max(birth_year) FROM who) - (SELECT quantile_cont(age::DOUBLE, 0.95) FROM ages)),
byc AS (SELECT birth_year, count(*) FILTER (sex = 'M') AS male, count(*) FILTER (sex = 'F') AS female, count(*) FILTER (sex = 'M' AND is_f) AS fathers, count(*) FILTER (sex = 'F' AND is_m) AS mothers FROM who WHERE birth_year IN (SELECT birth_year FROM hill) GROUP BY 1),
gate AS (""" + " UNION ALL ".join(
    [f"SELECT '{g}' AS gate, depth::VARCHAR AS cell, {c} AS n FROM byd" for g, c in (("depth", "n"), ("genomes_by_depth", "genomes"), ("cotwins_by_depth", "copies"), ("fathers_by_depth", "fathers"), ("mothers_by_depth", "mothers"), ("inbred_by_depth", "inb"), ("delta_f_used_by_depth", "used"))]
    + [f"SELECT 'depth_by_sex', depth || '/{s}', {s} FROM byd" for s in ("male", "female")]
    + ["SELECT 'inbred_f_by_depth', depth || '/' || format('{:.9f}', round(F, 9)), count(*) FROM who WHERE F > 1e-9 GROUP BY depth, round(F, 9)"]
    + ["SELECT 'related_families_by_depth', c.cohort::VARCHAR, CASE WHEN c.mean_kinship > 1e-12 THEN greatest(least(coalesce(f.families, 0), "
        "coalesce(s.shared, 0)), 1) ELSE 0 END FROM coh c LEFT JOIN fams f ON f.depth = c.cohort LEFT JOIN shar s ON s.depth = c.cohort"]
    + [f"SELECT '{g}', '', count(*) FILTER ({w}) FROM who" for g, w in (("reference_used", "ref AND ecg > 0"), ("reference_not_used", "NOT (ref AND ecg > 0)"), ("reference_inbred", "ref AND F > 1e-9"), ("reference_past_first_generation", "ref AND ecg > 1"))]
    + ["SELECT 'links_with_birth_years', CASE role WHEN 'father' THEN 'M' ELSE 'F' END, count(*) FROM ages GROUP BY role", "SELECT 'parents_with_birth_years', CASE role WHEN 'father' THEN 'M' ELSE 'F' END, count(DISTINCT parent) FROM ages GROUP BY role"]
    + [f"SELECT 'cohort_by_sex', birth_year || '/{s}', {s} FROM byc" for s in ("male", "female")]
    + [f"SELECT '{p}_by_cohort', birth_year::VARCHAR, {p} FROM byc" for p in ("fathers", "mothers")]
) + ")"
_GATE_PARTS = (_WALKS, _SHARES, _INBRED, _COHORT, _COUNTS, _DATED, _GATED)
_NEEDS = [(e, g, x) for e, groups in RELEASES.items() for g, (_, needs) in groups.items() for x in needs]
ORACLES["safe_size_gates"] = _sql("SELECT gate, cell, n::BIGINT AS n FROM gate", *_GATE_PARTS).replace(_PED, _PART)
ORACLES["safe_size_decisions"] = _sql(
    "SELECT estimator, part, bool_and(coalesce(o.open, false)) AS released FROM (VALUES " + ", ".join(f"('{e}', '{g}', '{x}')" for e, g, x in _NEEDS) + ") v(estimator, part, gate) LEFT JOIN (SELECT gate, bool_and(n = 0 OR n >= 5) AS open FROM gate GROUP BY 1) o USING (gate) GROUP BY 1, 2",
    *_GATE_PARTS,
).replace(_PED, _PART)
_MATE_CELLS = [(a, b) for a in "ob" for b in "ob"]
_MATE_GATES = _PAIRS + """,
per AS (SELECT id, CASE WHEN id % 7 <> 1 THEN floor(acctbal / 3000)::DOUBLE END AS o, CASE WHEN id % 5 <> 2 THEN (acctbal > 4000)::INT::DOUBLE END AS b FROM ped),
cou AS (SELECT q.mother, q.father, m.o AS m_o, f.o AS f_o, m.b AS m_b, f.b AS f_b FROM pairs q LEFT JOIN per m ON m.id = q.mother LEFT JOIN per f ON f.id = q.father),
mar AS (SELECT *, concat_ws(',', """ + ", ".join(f"CASE WHEN m_{a} IS NOT NULL AND f_{b} IS NOT NULL THEN '{a}x{b}' END" for a, b in _MATE_CELLS) + """) AS cells FROM cou),
rol AS (SELECT p.*, coalesce(r.role, 'others') AS role FROM per p LEFT JOIN (SELECT DISTINCT mother AS id, 'mothers' AS role FROM pairs UNION SELECT father, 'fathers' FROM pairs) r USING (id)),
gate AS (SELECT 'couples' AS gate, '' AS cell, count(*) AS n, least(count(DISTINCT mother), count(DISTINCT father)) AS units FROM mar
UNION ALL SELECT 'couples_by_cells', cells, count(*), least(count(DISTINCT mother), count(DISTINCT father)) FROM mar GROUP BY cells """ + " ".join(
    f"UNION ALL SELECT 'cell', '{a}x{b}', count(*), least(count(DISTINCT mother), count(DISTINCT father)) FROM mar WHERE m_{a} IS NOT NULL AND f_{b} IS NOT NULL HAVING count(*) > 0 "
    f"UNION ALL SELECT 'levels', '{a}x{b}:' || m_{a}::BIGINT || '/' || f_{b}::BIGINT, count(*), least(count(DISTINCT mother), count(DISTINCT father)) FROM mar WHERE m_{a} IS NOT NULL AND f_{b} IS NOT NULL GROUP BY m_{a}, f_{b}"
    for a, b in _MATE_CELLS
) + """
UNION ALL SELECT 'individuals', role, count(*), count(*) FROM rol GROUP BY role
""" + " ".join((f"UNION ALL SELECT 'trait_rows', '{t}:' || role || CASE WHEN {t} IS NULL THEN ':missing' ELSE ':with_value' END, count(*), count(*) FROM rol "
    f"GROUP BY ALL") for t in "ob") + ")"
ORACLES["safe_mate_gates"] = _sql("SELECT * FROM gate", _MATE_GATES)
ORACLES["safe_mate_decisions"] = _sql(
    "SELECT v.cell, NOT EXISTS (SELECT 1 FROM gate WHERE gate IN ('couples', 'couples_by_cells') AND least(n, units) < 5) AND EXISTS (SELECT 1 FROM gate g WHERE g.gate = 'cell' AND g.cell = v.cell) "
    "AND NOT EXISTS (SELECT 1 FROM gate g WHERE g.gate IN ('cell', 'levels') AND split_part(g.cell, ':', 1) = v.cell AND least(n, units) < 5) AS released FROM (VALUES " + ", ".join(f"('{a}x{b}')" for a, b in _MATE_CELLS) + ") v(cell)",
    _MATE_GATES,
)
ORACLES["birth_sets_by_decade"] = _sql("SELECT decade, count(*) AS n_sets, sum(size)::BIGINT AS n_members, count(*) FILTER (size > 2) AS n_larger FROM settab GROUP BY decade", _WALKS, _DATED, _BIRTHS)
ORACLES["recorded_sex_source"] = "SELECT f.id, CASE WHEN f.sex_source = 'input' AND f.id % 9 = 4 THEN 'imputed_from_role' ELSE f.sex_source END AS sex_source FROM (" + ORACLES["fixed_pedigree"] + ") f"


def _strata(least: int = 6, rounds: int = 12) -> str:
    """Thin and constant strata dropped, round by round; later rounds change nothing once the pairs are stable."""
    out = """,
k0 AS (SELECT q.mother, q.father, floor(m.acctbal / 3000)::DOUBLE AS x, f.acctbal AS y, m.birth_year // 10 AS ms, f.birth_year // 10 AS fs FROM pairs q JOIN dated m ON m.id = q.mother JOIN dated f ON f.id = q.father WHERE m.acctbal IS NOT NULL AND f.acctbal IS NOT NULL)"""
    for k in range(rounds):
        out += f""",
u{k} AS (SELECT mother AS a, father AS b FROM k{k} UNION SELECT father, mother FROM k{k}),
n{k} AS (SELECT DISTINCT a AS id, a AS c FROM u{k} UNION SELECT u.b, n.c FROM n{k} n JOIN u{k} u ON u.a = n.id WHERE n.c < u.b),
w{k} AS (SELECT k.*, n.c FROM k{k} k JOIN (SELECT id, min(c) AS c FROM n{k} GROUP BY id) n ON n.id = k.mother),
k{k + 1} AS (SELECT mother, father, x, y, ms, fs FROM w{k} WHERE ms NOT IN (SELECT ms FROM w{k} GROUP BY ms HAVING count(DISTINCT c) < {least} OR min(x) = max(x)) AND fs NOT IN (SELECT fs FROM w{k} GROUP BY fs HAVING count(DISTINCT c) < {least} OR min(y) = max(y)))"""
    return out


ORACLES["mate_full_strata"] = _sql("SELECT mother, father FROM k12", _WALKS, _PAIRS, _DATED, _strata()).replace(_PED, _PART)


def _ordered(least: int) -> str:
    """Small cells of tab(k, n) merged inward: a group takes in its right neighbours until it is large enough, the last one joins its left."""
    return f""",
lin AS (SELECT k, n, row_number() OVER (ORDER BY k) AS rn FROM tab WHERE n > 0),
acc AS (SELECT rn, k, n, 1 AS g, n AS run FROM lin WHERE rn = 1 UNION ALL SELECT l.rn, l.k, l.n, CASE WHEN a.run >= {least} THEN a.g + 1 ELSE a.g END, CASE WHEN a.run >= {least} THEN l.n ELSE a.run + l.n END FROM acc a JOIN lin l ON l.rn = a.rn + 1),
grp AS (SELECT g, min(k) AS a, max(k) AS b, sum(n) AS n FROM acc GROUP BY g),
fin AS (SELECT min(a) AS a, max(b) AS b, sum(n) AS n FROM (SELECT *, CASE WHEN n < {least} AND g > 1 THEN g - 1 ELSE g END AS h FROM grp) GROUP BY h)
SELECT CASE WHEN a = b THEN a::VARCHAR WHEN b = max(b) OVER () THEN a || '+' ELSE a || '-' || b END AS label, n::BIGINT AS n, CASE WHEN a = b THEN 'intact' ELSE 'merged' END AS status FROM fin"""


_SIBS = {"full_siblings": "mother, father", "maternal": "mother", "paternal": "father"}
_MOMENTS = " UNION ALL ".join(
    (f"SELECT '{g}' AS grouping, size, males FROM (SELECT count(*) AS size, count(*) FILTER (sex = 'M') AS males FROM ped WHERE sex IS NOT NULL "
        f"AND {' AND '.join(f'{k} IS NOT NULL' for k in keys.split(', '))} GROUP BY {keys} HAVING count(*) >= 2)")
    for g, keys in _SIBS.items()
)
ORACLES |= {
    "protected_depth_table": _sql("", _WALKS, ",\ntab AS (SELECT depth AS k, count(*) AS n FROM depth GROUP BY 1)", _ordered(100)),
    "protected_offspring_table": _sql("", ",\ntab AS (SELECT k, count(*) AS n FROM (SELECT p.id, count(e.child) AS k FROM ped p LEFT JOIN edges e ON e.parent = p.id GROUP BY p.id) "
        "GROUP BY k)", _ordered(20)),
    "protected_half_founders": _sql(
        """SELECT sex || '/' || known AS label, CASE WHEN (SELECT min(n) FROM cro) >= 3 THEN n END AS n FROM cro
UNION ALL SELECT known, CASE WHEN count(*) >= 20 AND count(DISTINCT family) >= 20 THEN count(*) END FROM kno GROUP BY known""",
        """,
kno AS (SELECT coalesce(sex, 'unknown') AS sex, CASE WHEN mother IS NULL AND father IS NULL THEN 'none' WHEN mother IS NULL THEN 'father' WHEN father IS NULL THEN 'mother' ELSE 'both' END AS known,
  CASE WHEN mother IS NULL AND father IS NULL THEN 'i' || id ELSE coalesce(mother::VARCHAR, '-') || '/' || coalesce(father::VARCHAR, '-') END AS family FROM ped),
cro AS (SELECT sex, known, count(*) AS n FROM kno GROUP BY ALL)""",
    ).replace(_PED, _PART),
    "protected_categories": _sql(
        """SELECT k AS label, n, 'intact' AS status FROM cat WHERE place > 2 UNION ALL SELECT 'other', sum(n)::BIGINT, 'merged' FROM cat WHERE place <= 2""",
        ",\ncat AS (SELECT k, n, row_number() OVER (ORDER BY n, k DESC) AS place FROM (SELECT CASE WHEN id % 7 = 3 THEN 'rare' WHEN id % 11 = 3 THEN "
            "'rarer' ELSE segment END AS k, count(*) AS n FROM ped GROUP BY 1))",
    ),
    "sex_concordance_moments": _sql(
        """SELECT grouping, p::BIGINT AS pairs, c::BIGINT AS concordant, round(e, 6) AS expected, round(v, 6) AS variance, round((c - e) / sqrt(v), 6) AS z FROM (SELECT *, p * q2 AS e, p * q2 + t * q3 + (p * p - p - t) * q22 - p * q2 * p * q2 AS v FROM (
SELECT *, (m * (m - 1) + f * (f - 1)) / (n * (n - 1)) AS q2, (m * (m - 1) * (m - 2) + f * (f - 1) * (f - 2)) / (n * (n - 1) * (n - 2)) AS q3,
  (m * (m - 1) * (m - 2) * (m - 3) + f * (f - 1) * (f - 2) * (f - 3) + 2 * m * (m - 1) * f * (f - 1)) / (n * (n - 1) * (n - 2) * (n - 3)) AS q22
FROM (SELECT grouping, sum(size)::DOUBLE AS n, sum(males)::DOUBLE AS m, sum(size - males)::DOUBLE AS f, sum(size * (size - 1) / 2)::DOUBLE AS p, sum(size * (size - 1) * (size - 2))::DOUBLE AS t, sum((males * (males - 1) + (size - males) * (size - males - 1)) / 2)::DOUBLE AS c FROM mom GROUP BY 1)))""",
        ",\nmom AS (" + _MOMENTS + ")",
    ).replace(_PED, _PART),
    "sex_concordance_skips": "SELECT * FROM (VALUES ('no sex', 'no_input_sex'), ('one group', 'fewer_than_two_eligible_groups'), ('one sex', 'single_sex')) t(\"case\", "
        "skipped)",
    "topological_order": _sql("SELECT id, row_number() OVER (ORDER BY depth, id) AS place FROM depth", _WALKS).replace(_PED, _PART),
    "reduction": "WITH" + _DIRTY + """,
yr AS (SELECT DISTINCT c.id, c.birth_year - p.birth_year AS age FROM lnk l JOIN src c ON c.id = l.id JOIN src p ON p.id = l.parent)
SELECT id::VARCHAR AS id, 'birth_year_range' AS "check", 1 AS round FROM src WHERE birth_year NOT BETWEEN 1800 AND 2026 UNION ALL SELECT DISTINCT id::VARCHAR, 'birth_year_topology', 1 FROM yr WHERE age < 12 OR age > 81""",
}

_LINE = ", ".join(f"'{c[0]}'" for c in CODES if not c[3] and c[0] != "MZ")
ORACLES["safe_pair_support"] = _sql(
    """SELECT code, n, least(families, coalesce(ancestors, families)) AS units FROM (SELECT code, count(*) // 2 AS n, count(DISTINCT family) AS families FROM (SELECT code, id1 AS id FROM rel UNION ALL SELECT code, id2 FROM rel) JOIN fami USING (id) GROUP BY code)
LEFT JOIN (SELECT code, count(DISTINCT anc) AS ancestors FROM anc GROUP BY code) USING (code)""",
    _WALKS,
    _related(3),
    f""",
fami AS (SELECT id, CASE WHEN mother IS NULL AND father IS NULL THEN 'i' || id ELSE coalesce(mother::VARCHAR, '-') || '/' || coalesce(father::VARCHAR, '-') END AS family FROM ped),
anc AS (SELECT code, id2 AS anc FROM rel WHERE code IN ({_LINE}) UNION ALL SELECT r.code, CASE r.code WHEN 'PHS' THEN p.father ELSE p.mother END FROM rel r JOIN ped p ON p.id = r.id1 WHERE r.code IN ('FS', 'MHS', 'PHS'))""",
).replace(_PED, _PART).replace("SELECT id, mother, 1 FROM ped", _TWINS + " UNION ALL SELECT id, mother, 1 FROM ped")
