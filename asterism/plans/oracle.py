"""DuckDB SQL that states, independently of the operators, what every catalog query returns."""

from __future__ import annotations

import math

from ..constants import (
    BOX_PAD, ELBOW_K_MAX, ELBOW_K_MIN, EMPTY_LABEL, KMEANS_MAX_ITER, KMEANS_SEED, LABEL_SEPARATOR, STOPWORDS,
    TURN_ANGLE, WHITESPACE,
)
from ..functions.draws import sql_exponential
from ..operators.kmeans import TIE
from ..sources.vectors import HASH_DIM
from .catalog import (
    BOX, CAP, FIXED_K, LINE_K, RADIUS, RECLUSTER_K, SEEDS, TOP_K, TURN, TURNS,
)

_WS = "".join(f"\\x{{{ord(c):04x}}}" for c in WHITESPACE)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rnd(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


# ---- text ----------------------------------------------------------------------------------------


def _lines(text: str) -> str:
    trim = f"regexp_replace(s, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
    parts = f"string_split(coalesce({text}, ''), chr(10))"
    return f"list_filter(list_transform({parts}, lambda s: {trim}), lambda s: s <> '')"


LINES = f"""
lines AS (
  SELECT doc_id, (i - 1)::INT AS pos, ls[i] AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, {_lines('text')} AS ls FROM documents))
)"""


def _tokens(text: str) -> str:
    stop = "[" + ", ".join(_quote(w) for w in STOPWORDS) + "]"
    clean = f"regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}{_WS}'']', ' ', 'g')"
    astral = "regexp_matches(t, '[\\x{10000}-\\x{10FFFF}]')"
    return (
        f"list_filter(regexp_split_to_array({clean}, '[{_WS}]+'), lambda t: "
        f"(length(t) > 2 OR (length(t) = 2 AND {astral})) "
        f"AND NOT list_contains({stop}, t) AND NOT regexp_full_match(t, '\\p{{N}}+'))"
    )


def _term_ctes(source: str, group: str, where: str) -> str:
    """Expects a relation ``source`` with the group column and text."""
    return f"""
terms AS (
  SELECT DISTINCT rid, {group}, unnest({_tokens('text')}) AS term
  FROM (SELECT row_number() OVER () AS rid, * FROM {source}) WHERE {where}
),
term_counts AS (SELECT {group}, term, count(*) AS tf FROM terms GROUP BY ALL),
term_totals AS (SELECT term, count(*) AS df FROM terms GROUP BY ALL),
ranked AS (
  SELECT {group}, term, tf, df, tf * ln(1 + (SELECT count(*) FROM {source}) / df) AS score,
         row_number() OVER (PARTITION BY {group}
           ORDER BY tf * ln(1 + (SELECT count(*) FROM {source}) / df) DESC, term COLLATE "en", term) AS rank
  FROM term_counts JOIN term_totals USING (term)
),
labels_of AS (
  SELECT {group}, string_agg(term, '{LABEL_SEPARATOR}' ORDER BY rank) AS label
  FROM ranked WHERE rank <= 3 GROUP BY ALL
)"""


def _cell(text: str) -> str:
    body = f"regexp_replace({text}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
    decimal = (
        f"(regexp_full_match({body}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
        f"AND coalesce(abs(try_cast({body} AS DOUBLE)) < 'inf'::DOUBLE, false))"
    )
    radix = f"regexp_full_match({body}, '0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)')"
    risky = f"regexp_matches({text}, '^[=+\\-@\\t\\r]')"
    return (
        f"(SELECT CASE WHEN regexp_matches(g, '[\",\\r\\n]') THEN '\"' || replace(g, '\"', '\"\"') || '\"' "
        f"ELSE g END FROM (SELECT CASE WHEN {risky} AND NOT ({decimal} OR {radix}) "
        f"THEN '''' || {text} ELSE {text} END AS g))"
    )


def _number(value: str) -> str:
    return f"regexp_replace(regexp_replace(({value})::DECIMAL(20,4)::VARCHAR, '0+$', ''), '\\.$', '')"


def _round4(value: str) -> str:
    return f"(floor({value} * 1e4 + 0.5) / 1e4)"


# ---- points in the plane -------------------------------------------------------------------------

POINTS = """
points AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS x, l_extendedprice AS y,
         (l_linenumber - 1)::INT AS cluster
  FROM lineitem
)"""


def _normalized(source: str, extra: str) -> str:
    """Select of ``source`` with x, y normalised."""
    return f"""
  SELECT {extra}, 2 * (x - (x0 + x1) / 2) / span AS x, 2 * (y - (y0 + y1) / 2) / span AS y
  FROM {source}, (SELECT *, greatest(CASE WHEN x1 = x0 THEN 1 ELSE x1 - x0 END,
                                     CASE WHEN y1 = y0 THEN 1 ELSE y1 - y0 END) AS span
                  FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {source}))"""


def _turned(source: str, extra: str, angle: float) -> str:
    c, s = repr(math.cos(angle)), repr(math.sin(angle))
    return f"SELECT {extra}, x * {c} - y * {s} AS x, x * {s} + y * {c} AS y FROM {source}"


CENTRES_2D = f"""
centres AS (
  SELECT c.cluster, coalesce(avg(x), 0.0) AS cx, coalesce(avg(y), 0.0) AS cy
  FROM (SELECT unnest(range({LINE_K}))::INT AS cluster) c LEFT JOIN points USING (cluster)
  GROUP BY ALL
)"""

# ---- vectors -------------------------------------------------------------------------------------

VECTORS = """
v AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS f FROM embeddings)"""


def _hashed(source: str) -> str:
    """CTEs ending in hashed(id, f): unit vectors of signed counts of hashed terms of (id, text)."""
    return f"""
codes AS (
  SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h
  FROM (SELECT id, unnest({_tokens('text')}) AS t FROM {source})),
bucket_sums AS (
  SELECT id, h % {HASH_DIM} AS bucket, sum(CASE WHEN (h // {HASH_DIM}) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS s
  FROM codes GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(s * s)) AS z FROM bucket_sums GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT id, list(CASE WHEN coalesce(z, 0) = 0 THEN 0.0 ELSE coalesce(s, 0.0) / z END ORDER BY bucket) AS f
  FROM (SELECT id, unnest(range({HASH_DIM})) AS bucket FROM {source})
  LEFT JOIN bucket_sums USING (id, bucket) LEFT JOIN norms USING (id) GROUP BY id)"""


ITEMS = f"""
texts AS (SELECT doc_id AS id, text FROM documents),
{_hashed('texts')},
v AS MATERIALIZED (
  SELECT id, text, coalesce(embedding::DOUBLE[], hashed.f) AS f
  FROM texts JOIN hashed USING (id) LEFT JOIN embeddings ON vec_id = id
)"""
LINE_ITEMS = f"""
{LINES},
texts AS MATERIALIZED (
  SELECT (doc_id - (SELECT min(doc_id) FROM documents)) * (SELECT max(pos) + 1 FROM lines) + pos AS id, line AS text
  FROM lines),
{_hashed('texts')},
v AS MATERIALIZED (SELECT id, text, f FROM texts JOIN hashed USING (id))"""
# More rounds than the data need: a model that is at rest stays so.
ROUNDS = KMEANS_MAX_ITER


def _means(keys: str, rows: str) -> str:
    """Mean vector per key of a relation with (keys, f)."""
    return f"""
  SELECT {keys}, list(m ORDER BY p) AS f FROM (
    SELECT {keys}, p, avg(x) AS m
    FROM (SELECT {keys}, unnest(f) AS x, generate_subscripts(f, 1) AS p FROM {rows}) GROUP BY ALL
  ) GROUP BY ALL"""


LABEL_CENTRES = f"""
lc AS MATERIALIZED ({_means('label', 'v')})"""
NEAREST_LABEL = """
near AS (
  SELECT v.id, lc.label AS cluster, list_distance(v.f, lc.f) AS d
  FROM v, lc QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY list_distance(v.f, lc.f), lc.label) = 1
)"""


def _seeds(k: int) -> str:
    e = [sql_exponential("id", KMEANS_SEED, t) for t in range(k)]
    ctes = [
        f"s0 AS MATERIALIZED (SELECT id, f FROM v ORDER BY {e[0]}, id LIMIT 1)",
        "d0 AS MATERIALIZED (SELECT v.id, v.f, list_distance(v.f, s0.f) ** 2 AS d FROM v, s0)",
    ]
    for t in range(1, k):
        ctes.append(
            f"s{t} AS MATERIALIZED (SELECT id, f FROM d{t - 1} WHERE d > 0 ORDER BY {e[t]} / d, id LIMIT 1)"
        )
        ctes.append(
            f"d{t} AS MATERIALIZED (SELECT a.id, a.f, least(a.d, list_distance(a.f, s{t}.f) ** 2) AS d "
            f"FROM d{t - 1} a, s{t})"
        )
    union = " UNION ALL ".join(f"SELECT {t} AS step, id, f FROM s{t}" for t in range(k))
    return ",\n".join([*ctes, f"seeds AS MATERIALIZED ({union})"])


def _lloyd(ks: list[int], rounds: int) -> str:
    """a{rounds}(k, id, cluster) and c{rounds}(k, cluster, f) after that many rounds."""
    models = ", ".join(f"({k})" for k in ks)
    ctes = [
        f"c0 AS MATERIALIZED (SELECT m.k, step AS cluster, f FROM seeds, (VALUES {models}) m(k) WHERE step < m.k)"
    ]
    for t in range(1, rounds + 1):
        ctes.append(
            f"a{t} AS MATERIALIZED (SELECT k, id, f, cluster FROM (SELECT c.k, v.id, v.f, c.cluster, "
            f"list_distance(v.f, c.f) AS d, min(d) OVER (PARTITION BY c.k, v.id) AS least FROM v, c{t - 1} c) "
            f"WHERE d <= least + {TIE} QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY cluster) = 1)"
        )
        ctes.append(
            f"m{t} AS MATERIALIZED ({_means('k, cluster', f'a{t}')})"
        )
        ctes.append(
            f"c{t} AS MATERIALIZED (SELECT c.k, c.cluster, coalesce(m.f, c.f) AS f "
            f"FROM c{t - 1} c LEFT JOIN m{t} m USING (k, cluster))"
        )
    ctes.append(
        f"curve AS MATERIALIZED (SELECT a.k, sum(list_distance(a.f, c.f) ** 2) AS inertia "
        f"FROM a{rounds} a JOIN c{rounds} c USING (k, cluster) GROUP BY ALL)"
    )
    return ",\n".join(ctes)


ALL_K = list(range(ELBOW_K_MIN, ELBOW_K_MAX + 1))
ELBOW = f"""
chosen AS MATERIALIZED (
  SELECT k FROM curve,
    (SELECT min(k) AS x0, max(k) AS x1, arg_min(inertia, k) AS y0, arg_max(inertia, k) AS y1 FROM curve)
  ORDER BY abs((y1 - y0) * k - (x1 - x0) * inertia + x1 * y0 - y1 * x0) DESC, k LIMIT 1
)"""

COV = """
cells AS (SELECT id, unnest(f) AS x, generate_subscripts(f, 1) AS p FROM v),
mu AS MATERIALIZED (SELECT p, avg(x) AS m FROM cells GROUP BY ALL),
centred AS MATERIALIZED (SELECT id, p, x - m AS x FROM cells JOIN mu USING (p)),
cov AS MATERIALIZED (
  SELECT a.p AS i, b.p AS j, sum(a.x * b.x) / (SELECT count(*) FROM v) AS s
  FROM centred a JOIN centred b USING (id) GROUP BY ALL
)"""


def _eigenvector(source: str, name: str, squarings: int = 13) -> str:
    """Leading eigenvector ``name``(p, w) of a symmetric matrix by squaring it again and again."""
    ctes, last = [], source
    for t in range(squarings):
        new = f"{name}_q{t}"
        ctes.append(
            f"{new} AS MATERIALIZED (WITH n AS (SELECT sqrt(sum(s * s)) AS z FROM {last}), "
            f"u AS (SELECT i, j, s / z AS s FROM {last}, n) "
            f"SELECT a.i, b.j, sum(a.s * b.s) AS s FROM u a JOIN u b ON a.j = b.i GROUP BY ALL)"
        )
        last = new
    ctes.append(
        f"{name} AS MATERIALIZED (WITH col AS (SELECT i AS p, s AS w FROM {last} WHERE j = "
        f"(SELECT i FROM {last} WHERE i = j ORDER BY s DESC, i LIMIT 1)), "
        f"z AS (SELECT sqrt(sum(w * w)) AS z FROM col), "
        f"g AS (SELECT CASE WHEN w > 0 THEN 1 ELSE -1 END AS g FROM col ORDER BY abs(w) DESC, p LIMIT 1) "
        f"SELECT p, w / z * g AS w FROM col, z, g)"
    )
    return ",\n".join(ctes)


PCA = f"""
{COV},
{_eigenvector('cov', 'w1')},
lam AS MATERIALIZED (SELECT sum(a.w * s * b.w) AS l FROM cov JOIN w1 a ON a.p = i JOIN w1 b ON b.p = j),
rest AS MATERIALIZED (
  SELECT i, j, s - l * a.w * b.w AS s FROM cov JOIN w1 a ON a.p = i JOIN w1 b ON b.p = j, lam
),
{_eigenvector('rest', 'w2')},
raw AS MATERIALIZED (
  SELECT id, sum(x * w1.w) AS x, sum(x * w2.w) AS y
  FROM centred JOIN w1 USING (p) JOIN w2 USING (p) GROUP BY ALL
),
coords AS MATERIALIZED ({_normalized('raw', 'id')})"""


def _map(k: int | None, items: str = ITEMS, rounds: int = ROUNDS) -> str:
    """CTEs ending in mp(id, text, x, y, cluster) and named(id, label, size)."""
    ks = ALL_K if k is None else [k]
    pick = f"{ELBOW}," if k is None else f"chosen AS (SELECT {k} AS k),"
    return f"""
{items},
{_seeds(max(ks))},
{_lloyd(ks, rounds)},
{pick}
{PCA},
mp AS MATERIALIZED (
  SELECT id, text, x, y, a.cluster FROM a{rounds} a JOIN chosen USING (k)
  JOIN coords USING (id) JOIN (SELECT id, text FROM v) USING (id)
),
{_term_ctes('mp', 'cluster', 'cluster IS NOT NULL')},
named AS MATERIALIZED (
  SELECT cluster AS id, coalesce(label, '{EMPTY_LABEL}') AS label, size
  FROM (SELECT cluster, count(*) AS size FROM mp GROUP BY ALL) LEFT JOIN labels_of USING (cluster)
)"""


EXPORT = f"""
er AS (
  SELECT mp.id, text AS line, cluster, coalesce(label, '') AS label,
         {_round4('x')} AS x, {_round4('y')} AS y
  FROM mp LEFT JOIN named ON named.id = mp.cluster
)"""


# Documents with a stored vector give the map; all documents are placed on it.
SAVED = f"""
texts AS (SELECT doc_id AS id, text FROM documents),
{_hashed('texts')},
everything AS MATERIALIZED (
  SELECT id, coalesce(embedding::DOUBLE[], hashed.f) AS f FROM hashed LEFT JOIN embeddings ON vec_id = id),
v AS MATERIALIZED (SELECT vec_id AS id, text, embedding::DOUBLE[] AS f FROM embeddings JOIN documents ON doc_id = vec_id),
{_seeds(FIXED_K)},
{_lloyd([FIXED_K], ROUNDS)},
{PCA},
near AS (
  SELECT id, cluster FROM (
    SELECT e.id, c.cluster, list_distance(e.f, c.f) AS d, min(d) OVER (PARTITION BY e.id) AS least
    FROM everything e, c{ROUNDS} c)
  WHERE d <= least + {TIE} QUALIFY row_number() OVER (PARTITION BY id ORDER BY cluster) = 1),
flat AS (
  SELECT id, sum((x - m) * w1.w) AS x, sum((x - m) * w2.w) AS y
  FROM (SELECT id, unnest(f) AS x, generate_subscripts(f, 1) AS p FROM everything)
  JOIN mu USING (p) JOIN w1 USING (p) JOIN w2 USING (p) GROUP BY ALL),
box AS (SELECT *, greatest(x1 - x0, y1 - y0) AS span
        FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM raw))"""


def _file_lines(records: str, text: str, order: str) -> str:
    """(id, line) of a text made of records in order."""
    return f"""
            SELECT row_number() OVER (ORDER BY {order}, i) - 1 AS id, ls[i] AS line
            FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, {_lines(text)} AS ls FROM {records}))"""


def _topk(rows: str) -> str:
    size = "sqrt(list_dot_product(a.f, a.f) * list_dot_product(b.f, b.f))"
    cosine = f"CASE WHEN {size} = 0 THEN 0.0 ELSE list_dot_product(a.f, b.f) / {size} END"
    return f"""
            sim AS (SELECT a.id AS probe_id, b.id, {rnd(cosine)} AS similarity FROM {rows} a JOIN {rows} b ON a.id <> b.id)
            SELECT probe_id, rank::INT AS rank, id, similarity FROM (
              SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, id) AS rank FROM sim
            ) WHERE rank <= {TOP_K}"""


def oracle_sql() -> dict[str, str]:
    fixed = _map(FIXED_K)
    terms = _term_ctes("documents", "lang", "lang IS NOT NULL")
    by_source = _term_ctes("documents", "source", "source IS NOT NULL")
    graded = "graded AS (SELECT doc_id, text, quality AS cluster FROM documents LEFT JOIN labels USING (doc_id))"
    w, h = BOX
    return {
        "parse_lines": f"WITH {LINES} SELECT doc_id, pos, line FROM lines",
        "cap_lines": f"WITH {LINES} SELECT doc_id, pos, line FROM lines ORDER BY doc_id, pos LIMIT {CAP}",
        "line_stats": f"""WITH {LINES} SELECT least(count(*), {CAP}) AS kept,
            greatest(count(*) - {CAP}, 0) AS truncated, least(count(*), {CAP}) >= 3 AS enough FROM lines""",
        "tokenize": f"""SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
            FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)""",
        "embed_hash": f"""
            WITH texts AS (SELECT doc_id AS id, text FROM documents), {_hashed('texts')}
            SELECT id, bucket, {rnd('value')} AS value FROM (
              SELECT id, unnest(f) AS value, (generate_subscripts(f, 1) - 1)::INT AS bucket FROM hashed)""",
        "embed_model": f"""WITH {LINES}, shapes AS (
              SELECT doc_id, pos, [length(line), length(line) - length(regexp_replace(line, '[aeiou]', '', 'g')),
                                   length(line) - length(replace(line, ' ', '')), 1]::DOUBLE[] AS f FROM lines)
            SELECT doc_id, pos, at_ AS "at", {rnd('x / z')} AS value FROM (
              SELECT doc_id, pos, sqrt(list_dot_product(f, f)) AS z, unnest(f) AS x, (generate_subscripts(f, 1) - 1)::INT AS at_
              FROM shapes)""",
        "file_lines": _file_lines("documents", "text", "doc_id"),
        "csv_guard": f"WITH {LINES} SELECT doc_id, pos, {_cell('line')} AS cell FROM lines",
        "valid_assignments": f"WITH {graded} SELECT doc_id, cluster FROM graded WHERE cluster BETWEEN 0 AND 1",
        "term_df": f"WITH {terms} SELECT lang, term, tf, df FROM term_counts JOIN term_totals USING (term)",
        "top_terms": f"""WITH {by_source} SELECT source, rank::INT AS rank, term, tf, df, {rnd('score')} AS score
            FROM ranked WHERE rank <= 5""",
        "label_groups": f"WITH {terms} SELECT lang, label FROM labels_of",
        "label_clusters": f"""WITH {graded}, {_term_ctes('graded', 'cluster', 'cluster BETWEEN 0 AND 2')}
            SELECT c.cluster, coalesce(label, '{EMPTY_LABEL}') AS label
            FROM (SELECT unnest(range(3))::INT AS cluster) c LEFT JOIN labels_of USING (cluster)""",
        "load_vectors": f"""WITH {VECTORS} SELECT id, len(f)::INT AS dim, {rnd('sqrt(list_dot_product(f, f))')} AS norm,
            {rnd('list_sum(f)')} AS total FROM v""",
        "vector_ops": f"""WITH {VECTORS}, {LABEL_CENTRES}
            SELECT id, {rnd('list_dot_product(v.f, lc.f)')} AS dot, {rnd('sqrt(list_dot_product(v.f, v.f))')} AS norm,
              {rnd('list_dot_product(v.f, lc.f) / sqrt(list_dot_product(v.f, v.f) * list_dot_product(lc.f, lc.f))')} AS cosine,
              {rnd('list_distance(v.f, lc.f)')} AS euclidean
            FROM v JOIN lc USING (label)""",
        "normalize_vectors": f"""WITH {VECTORS},
            s AS (SELECT id, list_transform(f, lambda x: x * label) AS f FROM v),
            z AS (SELECT id, f, sqrt(list_dot_product(f, f)) AS z FROM s)
            SELECT id, pos, {rnd('CASE WHEN z = 0 THEN x ELSE x / z END')} AS value
            FROM (SELECT id, z, unnest(f) AS x, (generate_subscripts(f, 1) - 1)::INT AS pos FROM z)""",
        "mean_vector": f"""WITH {VECTORS} SELECT pos, {rnd('avg(x)')} AS mean
            FROM (SELECT unnest(f) AS x, (generate_subscripts(f, 1) - 1)::INT AS pos FROM v) GROUP BY pos""",
        "group_centroids": f"""WITH {VECTORS} SELECT label, pos, {rnd('avg(x)')} AS value, count(*) AS size
            FROM (SELECT label, unnest(f) AS x, (generate_subscripts(f, 1) - 1)::INT AS pos FROM v) GROUP BY ALL""",
        "nearest_centroid": f"""WITH {VECTORS}, {LABEL_CENTRES}, {NEAREST_LABEL}
            SELECT id, cluster::INT AS cluster, {rnd('d * d')} AS d2 FROM near""",
        "nearest_document": f"""WITH {VECTORS}, texts AS (SELECT doc_id AS id, text FROM documents), {_hashed('texts')}
            SELECT id, cluster::INT AS cluster, {rnd('d * d')} AS d2 FROM (
              SELECT v.id, h.id AS cluster, list_distance(v.f, h.f) AS d, min(d) OVER (PARTITION BY v.id) AS least
              FROM v, hashed h)
            WHERE d <= least + {TIE} QUALIFY row_number() OVER (PARTITION BY id ORDER BY cluster) = 1""",
        "inertia": f"""WITH {VECTORS}, {LABEL_CENTRES}, {NEAREST_LABEL}
            SELECT count(*) AS n, {rnd('sum(d * d)', 5)} AS inertia FROM near""",
        "topk_similar": f"WITH {VECTORS}, {_topk('v')}",
        "similarity_join": f"""WITH texts AS (SELECT doc_id AS id, text FROM documents), {_hashed('texts')}, {_topk('hashed')}""",
        "covariance": f"""WITH {VECTORS}, {COV} SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, {rnd('s', 9)} AS cov FROM cov""",
        "remove_component": f"""WITH {VECTORS}, mean AS ({_means('one', '(SELECT 1 AS one, f FROM v)')}),
            dir AS (SELECT list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) AS w FROM mean)
            SELECT id, pos, {rnd('x - p * wi')} AS value FROM (
              SELECT id, list_dot_product(f, w) AS p, unnest(f) AS x, unnest(w) AS wi,
                     (generate_subscripts(f, 1) - 1)::INT AS pos FROM v, dir)""",
        "pca_2d": f"WITH {VECTORS}, {PCA} SELECT id, {rnd('x')} AS x, {rnd('y')} AS y FROM coords",
        "pca_by_passes": f"WITH {VECTORS}, {PCA} SELECT id, {rnd('x')} AS x, {rnd('y')} AS y FROM coords",
        "kmeans_seed": f"WITH {VECTORS}, {_seeds(SEEDS)} SELECT step::INT AS step, id FROM seeds",
        "kmeans": f"""WITH {VECTORS}, {_seeds(FIXED_K)}, {_lloyd([FIXED_K], ROUNDS)}
            SELECT id, cluster::INT AS cluster FROM a{ROUNDS}""",
        "kmeans_centroids": f"""WITH {VECTORS}, {_seeds(FIXED_K)}, {_lloyd([FIXED_K], ROUNDS)}
            SELECT cluster::INT AS cluster, pos, {rnd('x')} AS value FROM (
              SELECT cluster, unnest(f) AS x, (generate_subscripts(f, 1) - 1)::INT AS pos FROM c{ROUNDS})""",
        "elbow_k": f"""WITH {VECTORS}, {_seeds(ELBOW_K_MAX)}, {_lloyd(ALL_K, ROUNDS)}, {ELBOW}
            SELECT k::INT AS k, {rnd('inertia')} AS inertia, k = (SELECT k FROM chosen) AS is_elbow FROM curve""",
        "build_map": f"""WITH {_map(None)} SELECT id, cluster::INT AS cluster, {rnd('x', 5)} AS x, {rnd('y', 5)} AS y,
            md5(text) AS text_md5 FROM mp""",
        "cluster_sizes": f"WITH {fixed} SELECT cluster::INT AS cluster, count(*) AS size FROM mp GROUP BY ALL",
        "legend": f"WITH {_map(None)} SELECT id::INT AS id, label, size FROM named ORDER BY id",
        "map_summary": f"""WITH {_map(None)} SELECT (SELECT k FROM chosen)::INT AS k, count(*) AS n_points,
            count(DISTINCT cluster) AS n_clusters FROM mp""",
        "recluster": f"""WITH {_map(RECLUSTER_K)} SELECT mp.id, cluster::INT AS cluster, label, size,
            {rnd('x', 5)} AS x, {rnd('y', 5)} AS y FROM mp JOIN named ON named.id = cluster""",
        "export_rows": f"WITH {fixed}, {EXPORT} SELECT line, cluster::INT AS cluster, label, x, y FROM er",
        "export_csv": f"""WITH {fixed}, {EXPORT} SELECT id, concat_ws(',', {_cell('line')}, {_cell('cluster::VARCHAR')},
            {_cell('label')}, {_cell(_number('x'))}, {_cell(_number('y'))}) AS record FROM er""",
        "export_json": f"""WITH {fixed}, {EXPORT} SELECT id, '{{"line":' || to_json(line)::VARCHAR || ',"cluster":' || cluster::VARCHAR
            || ',"label":' || to_json(label)::VARCHAR || ',"x":' || {_number('x')} || ',"y":' || {_number('y')} || '}}' AS record FROM er""",
        "export_document": f"""WITH {fixed}, {EXPORT}, groups AS (
              SELECT 1 AS part, id, '{{"id":' || id::VARCHAR || ',"label":' || to_json(label)::VARCHAR || ',"size":' || size::VARCHAR || '}}' AS record
              FROM named
              UNION ALL SELECT 3, id, '{{"line":' || to_json(line)::VARCHAR || ',"cluster":' || cluster::VARCHAR
                || ',"label":' || to_json(label)::VARCHAR || ',"x":' || {_number('x')} || ',"y":' || {_number('y')} || '}}' FROM er)
            SELECT part::INT AS part, id::BIGINT AS id,
              CASE WHEN id = min(id) OVER (PARTITION BY part) THEN '' ELSE ',' END || record AS record FROM groups
            UNION ALL SELECT 0, 0, '{{"k":{FIXED_K},"clusters":[' UNION ALL SELECT 2, 0, '],"points":[' UNION ALL SELECT 4, 0, ']}}'""",
        "export_csv_file": f"""WITH {fixed}, {EXPORT}, parts AS (
              SELECT 0 AS part, 0 AS id, 'line,cluster,label,x,y' AS record
              UNION ALL SELECT 1, id, concat_ws(',', {_cell('line')}, {_cell('cluster::VARCHAR')},
                {_cell('label')}, {_cell(_number('x'))}, {_cell(_number('y'))}) FROM er)
            {_file_lines('parts', 'record', 'part, id')}""",
        "place_on_saved_map": f"""WITH {SAVED}
            SELECT id, cluster::INT AS cluster, {rnd('2 * (x - (x0 + x1) / 2) / span', 5)} AS x,
              {rnd('2 * (y - (y0 + y1) / 2) / span', 5)} AS y FROM near JOIN flat USING (id), box""",
        "reproject_export": f"""WITH {fixed}, t AS ({_turned('mp', 'id, cluster', TURN_ANGLE * TURNS)}),
            r AS ({_normalized('t', 'id, cluster')})
            SELECT r.id, cluster::INT AS cluster, label, {_round4('x')} AS x, {_round4('y')} AS y FROM r JOIN named ON named.id = cluster""",
        "lines_map": f"""WITH {_map(None, LINE_ITEMS)} SELECT mp.id, cluster::INT AS cluster, label, {rnd('x', 5)} AS x,
            {rnd('y', 5)} AS y FROM mp JOIN named ON named.id = cluster""",
        "normalize_coords": f"""WITH {POINTS}, n AS ({_normalized('points', 'id')})
            SELECT id, {rnd('x')} AS x, {rnd('y')} AS y FROM n""",
        "rotate_coords": f"""WITH {POINTS}, n AS ({_normalized('points', 'id')}), t AS ({_turned('n', 'id', TURN)})
            SELECT id, {rnd('x')} AS x, {rnd('y')} AS y FROM t""",
        "reproject": f"""WITH {POINTS}, n AS ({_normalized('points', 'id, cluster')}),
            t AS ({_turned('n', 'id, cluster', TURN_ANGLE * TURNS)}), r AS ({_normalized('t', 'id, cluster')})
            SELECT id, cluster, {rnd('x')} AS x, {rnd('y')} AS y FROM r""",
        "scale_to_box": f"""WITH {POINTS}, n AS ({_normalized('points', 'id')})
            SELECT id, {rnd(f'{BOX_PAD} + (x + 1) / 2 * greatest(1, {w} - 2 * {BOX_PAD})')} AS x,
                   {rnd(f'{BOX_PAD} + (y + 1) / 2 * greatest(1, {h} - 2 * {BOX_PAD})')} AS y FROM n""",
        "isolate": f"WITH {POINTS} SELECT id, x, y FROM points WHERE cluster = 2",
        "highlight": f"WITH {POINTS} SELECT id, cluster, cluster <> 2 AS dimmed FROM points",
        "cluster_centroids_2d": f"WITH {POINTS}, {CENTRES_2D} SELECT cluster, {rnd('cx', 5)} AS x, {rnd('cy', 5)} AS y FROM centres",
        "constellation_edges": f"""WITH {POINTS}, {CENTRES_2D}
            SELECT id, x, y, {rnd('cx', 5)} AS cx, {rnd('cy', 5)} AS cy, cluster FROM points JOIN centres USING (cluster)""",
        "siblings": """WITH probes AS (SELECT doc_id AS id FROM labels WHERE toxic = 1),
            hit AS (SELECT vec_id AS id, label AS cluster, q.id IS NOT NULL AS is_probe
                    FROM embeddings LEFT JOIN probes q ON q.id = vec_id),
            n AS (SELECT cluster, count(*) AS n_probes FROM hit WHERE is_probe GROUP BY ALL)
            SELECT id, cluster, n_probes, is_probe, n_probes > is_probe::INT AS is_sibling FROM hit JOIN n USING (cluster)""",
        "pick_nearest": f"""WITH {POINTS}, probes AS (
              SELECT l_orderkey AS probe_id, (min(l_quantity) + max(l_quantity)) / 2 AS px,
                     (min(l_extendedprice) + max(l_extendedprice)) / 2 AS py FROM lineitem GROUP BY ALL),
            hit AS (
              SELECT probe_id, id, (x - px) * (x - px) + (y - py) * (y - py) AS d2 FROM probes JOIN points
              ON y BETWEEN py - {RADIUS} AND py + {RADIUS} AND x BETWEEN px - {RADIUS} AND px + {RADIUS}),
            best AS (SELECT probe_id, id FROM hit WHERE d2 <= {RADIUS * RADIUS}
              QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY d2, id DESC) = 1)
            SELECT probe_id, coalesce(best.id, -1) AS id FROM probes LEFT JOIN best USING (probe_id)""",
    }
