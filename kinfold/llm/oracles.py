"""DuckDB SQL for those queries of this subpackage that SQL can express, at the sizes the driver compares.

The others need a tokenizer, a trained model, an HTML parser or statistical tests; ``tests/llm`` holds plain versions.
"""

from __future__ import annotations

from kinfold.llm.license_scan import PHRASES, TEMPLATES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents WHERE doc_id IS NOT NULL),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(50)) AS k FROM win JOIN least USING (h) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.p) AS t FROM word x ANTI JOIN cov USING (doc_id, p) GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept k USING (doc_id)"""

OP3 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_SPACED}') AS w FROM documents WHERE doc_id IS NOT NULL),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
und AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
cc AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT u.b, cc.c FROM cc JOIN und u ON u.a = cc.id WHERE cc.c < u.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM cc WHERE cc.id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""

OP5 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM pat),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, size)),
hit AS MATERIALIZED (SELECT win.doc_id, win.i, win.n, pat.item_id FROM win JOIN pat USING (n, s)),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(item.s, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)"""

OP9 = """
WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.x, c.x), lambda t: t[1] * t[2]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def _op8() -> str:
    """Base phrases place by place; template 5-grams as strings, voted by diagonal, merged within a drift of 4."""
    words = rf"regexp_extract_all(translate(coalesce({{0}}, ''), '{_UP}', '{_LOW}'), '{_ALNUM}')"
    bodies = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    phrases = ", ".join(f"('{k}', '{v}', {len(k.split())})" for k, v in PHRASES.items())
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {words.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
ph AS (SELECT * FROM (VALUES {phrases}) t(phrase, label, n)),
base AS MATERIALIZED (SELECT id, label, i - 1 AS spot FROM (SELECT id, w, label, phrase, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, ph) WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
own AS (SELECT id, count(*) AS n, min(spot) AS lo, max(spot) AS hi, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY id),
t AS (SELECT label, {words.format("body")} AS w FROM (VALUES {bodies}) v(label, body)),
tg AS MATERIALIZED (SELECT label, len(w) - 4 AS grams, i AS t, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT label, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
dg AS (SELECT id, i AS p, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
hit AS MATERIALIZED (SELECT id, label, grams, p, t, p - t AS diagonal FROM dg JOIN tg USING (g)),
far AS (SELECT id, label, diagonal, CASE WHEN diagonal - lag(diagonal) OVER o <= 4 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT id, label, diagonal FROM hit) WINDOW o AS (PARTITION BY id, label ORDER BY diagonal)),
ses AS (SELECT *, sum(new) OVER (PARTITION BY id, label ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM far),
spa AS (SELECT id, label, any_value(grams) AS grams, count(DISTINCT t) AS votes, min(p) AS lo, max(p) + 5 AS hi FROM hit JOIN ses USING (id, label, diagonal) GROUP BY id, label, span),
more AS (SELECT id, list_distinct(list(label)) AS labels, max(votes / grams::DOUBLE) AS best FROM spa WHERE votes / grams::DOUBLE >= 0.5 AND hi - lo <= 2 * (grams + 5) GROUP BY id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(own.n, 0)::BIGINT AS n_base, own.lo::BIGINT AS first_word, own.hi::BIGINT AS last_word, array_to_string(coalesce(own.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own.labels, []), coalesce(more.labels, [])))), ',') AS labels, CASE WHEN own.n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN own USING (id) LEFT JOIN more USING (id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op8_license_scan": _op8(), "op3_jaccard_join": OP3, "op5_decontamination": OP5, "op9_nearest_neighbours": OP9}
