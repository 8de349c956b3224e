"""DuckDB SQL for the queries, over the driver's tables."""

from __future__ import annotations


from ..functions import expr
from . import bridge

PRESENCE = "presence AS (SELECT DISTINCT o_custkey::VARCHAR AS locality_id, l_partkey::VARCHAR AS species_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
LOC = """loc AS (SELECT c_custkey::VARCHAR AS locality_id, c_custkey AS key, (300000 + (c_custkey * 7919) % 97 * 2500)::DOUBLE AS e, (6200000 + (c_custkey * 104729) % 89 * 2500)::DOUBLE AS n,
  55.0::DOUBLE + ((c_custkey * 7919) % 1450)::DOUBLE / 100 AS lat, 10.0::DOUBLE + ((c_custkey * 104729) % 1500)::DOUBLE / 100 AS lon, c_mktsegment AS sci, n_regionkey::BIGINT AS cluster FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
CELLS = "cells AS (SELECT *, floor(e / 10000)::BIGINT AS gx, floor(n / 10000)::BIGINT AS gy, 'gx' || floor(e / 10000)::BIGINT || '_gy' || floor(n / 10000)::BIGINT AS cell_id FROM loc)"
COUNTS = "counts AS (SELECT cell_id, species_id, count(*) AS \"count\" FROM presence JOIN cells USING (locality_id) GROUP BY ALL)"
SITES = "sites AS (SELECT c_mktsegment AS sci, c_custkey AS fid, (500000 + (c_custkey * 7919) % 400 * 10)::DOUBLE AS e, (6500000 + (c_custkey * 104729) % 400 * 10)::DOUBLE AS n FROM customer)"
POINTS = "points AS (SELECT substr(o_orderpriority, 1, 1) || '-' || o_orderstatus AS tid, o_orderkey AS pid, 'loc ' || (o_orderkey % 500) AS locality, (500000 + (o_orderkey * 15485863) % 400 * 10)::DOUBLE AS e, (6500000 + (o_orderkey * 32452843) % 397 * 10)::DOUBLE AS n FROM orders)"
HITS = f"{SITES}, {POINTS}, hits AS (SELECT sci, fid, tid, pid, locality, p.e AS e, p.n AS n, (s.e - p.e) * (s.e - p.e) + (s.n - p.n) * (s.n - p.n) AS d2 FROM sites s JOIN points p ON (s.e - p.e) * (s.e - p.e) + (s.n - p.n) * (s.n - p.n) <= 2500)"
RED = "red AS (SELECT unnest(['1-O', '2-F', '3-P', '5-O']) AS id)"
KEPT = "kept AS (SELECT sci, tid, count(*) AS n FROM hits WHERE tid NOT IN ('', 'NA') GROUP BY ALL HAVING count(*) >= 15)"
COMM = """comm AS (SELECT (floor(((o_custkey * 7919) % 97) / 8)::BIGINT * 1000 + floor(((o_custkey * 104729) % 89) / 8)::BIGINT) AS cell_id, p_brand || '-' || p_type AS species_id, count(*) AS "count"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
f AS (SELECT cell_id, species_id, sqrt("count"::DOUBLE / sum("count") OVER (PARTITION BY cell_id)) AS value FROM comm),
labels AS (SELECT DISTINCT cell_id, cell_id % 4 AS cluster FROM f)"""
SUMMARY = f"""{COMM}, fl AS (SELECT * FROM f JOIN labels USING (cell_id)), sizes AS (SELECT cluster, count(*) AS n_in FROM labels GROUP BY 1), n AS (SELECT count(*) AS n_all FROM labels),
inside AS (SELECT cluster, species_id, sum(value) AS s_in, sum(value * value) AS q_in, count(*) AS k_in FROM fl GROUP BY ALL), whole AS (SELECT species_id, sum(value) AS s_all, sum(value * value) AS q_all, count(*) AS k_all FROM fl GROUP BY ALL),
m AS (SELECT *, n_all - n_in AS n_out, s_in / n_in AS mean_in, (s_all - s_in) / (n_all - n_in) AS mean_out, k_in / n_in AS prevalence_in, (k_all - k_in) / (n_all - n_in) AS prevalence_out, k_all / n_all AS prevalence, s_in / n_in - (s_all - s_in) / (n_all - n_in) AS delta
  FROM inside JOIN whole USING (species_id) JOIN sizes USING (cluster), n)"""
MWU = f"""{COMM}, sizes AS (SELECT cluster, count(*) AS n1 FROM labels GROUP BY 1), n AS (SELECT count(*) AS n FROM labels),
cross_ AS (SELECT l.cell_id, l.cluster, s.species_id, coalesce(round(f.value, 9), 0) AS value FROM labels l CROSS JOIN (SELECT DISTINCT species_id FROM f) s LEFT JOIN f ON f.cell_id = l.cell_id AND f.species_id = s.species_id),
ranked AS (SELECT *, rank() OVER (PARTITION BY species_id ORDER BY value) + (count(*) OVER (PARTITION BY species_id, value) - 1) / 2.0 AS r FROM cross_),
ties AS (SELECT species_id, sum(t::DOUBLE * t * t - t) AS t FROM (SELECT species_id, value, count(*) AS t FROM cross_ GROUP BY ALL) GROUP BY 1),
us AS (SELECT cluster, species_id, sum(r) - n1::DOUBLE * (n1 + 1) / 2 AS u, n1::DOUBLE AS n1, n - n1::DOUBLE AS n2, n::DOUBLE AS n, any_value(ties.t) AS t FROM ranked JOIN sizes USING (cluster) JOIN ties USING (species_id), n GROUP BY cluster, species_id, n1, n HAVING max(value) > 0),
mwu AS (SELECT cluster, species_id, n1::BIGINT AS n_in, n2::BIGINT AS n_out, u, CASE WHEN n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1))) > 0 THEN sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1)))) END AS z FROM us)"""
BH = f"""{MWU}, p AS (SELECT cluster, species_id, round(1 / (1 + coalesce(z, 0) * coalesce(z, 0)), 9) AS p FROM mwu),
raw AS (SELECT *, p * count(*) OVER (PARTITION BY cluster) / count(*) OVER (PARTITION BY cluster ORDER BY p RANGE UNBOUNDED PRECEDING) AS q0 FROM p),
bh AS (SELECT cluster, species_id, round(p, 6) AS p, round(greatest(0, least(1, min(q0) OVER (PARTITION BY cluster ORDER BY p DESC RANGE UNBOUNDED PRECEDING))), 6) AS q FROM raw)"""
WORDS = rf"""comm AS (SELECT cell_id, cluster, species_id, count(*) AS "count" FROM (
  SELECT coalesce(lang, '') || '|' || coalesce(source, '') AS cell_id, coalesce(list_position({list(bridge.LANGUAGES)}, lang), 0)::BIGINT AS cluster,
    unnest(list_distinct(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS species_id FROM documents) GROUP BY ALL),
f AS (SELECT cell_id, species_id, sqrt("count"::DOUBLE / sum("count") OVER (PARTITION BY cell_id)) AS value FROM comm),
labels AS (SELECT DISTINCT cell_id, cluster FROM comm)"""


def _tail(z: str) -> str:
    """Two-sided normal tail of a column, as in the queries."""
    low, coefficients = expr.tail_series()
    x = f"(abs({z}) / sqrt(2::DOUBLE))"
    t = f"(2::DOUBLE / (2 + {x}))"
    return f"CASE WHEN {x} < 26 THEN {t} * exp(list_reduce({coefficients[::-1]!r}::DOUBLE[], lambda a, c: a * (({t} - {low!r}::DOUBLE) * {2 / (1 - low)!r}::DOUBLE - 1) + c) - {x} * {x}) WHEN {z} IS NOT NULL THEN 0 END"


BANDS = f"{LOC}, q AS (SELECT sci, list_distinct(quantile_cont(lat, [{', '.join(str(i / 10) for i in range(11))}])) AS edges FROM loc GROUP BY 1), b AS (SELECT loc.*, 'LAT' || (greatest(len(list_filter(edges, lambda x: x < lat)) - 1, 0) + 1) AS latband FROM loc JOIN q USING (sci))"


def _uniform(seed: int, *columns: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(columns)})), 1, 13))::BIGINT + 1) / {float((1 << 52) + 1)!r})"


SCAN = f"""WITH s AS (WITH {SUMMARY.replace(COMM, WORDS)} SELECT *, ((n_in - 1) * ((q_in - s_in * s_in / n_in) / (n_in - 1)) + (n_out - 1) * ((q_all - q_in - (s_all - s_in) * (s_all - s_in) / n_out) / (n_out - 1))) / (n_in + n_out - 2) AS pooled FROM m),
u AS (WITH {MWU.replace(COMM, WORDS)} SELECT cluster, species_id, round(z, 9) AS z FROM mwu), species AS (WITH {WORDS} SELECT count(DISTINCT species_id) AS n_species FROM f),
tested AS (SELECT s.*, coalesce({_tail('u.z')} / 2, 1) AS p, n_species FROM s JOIN u USING (cluster, species_id), species WHERE prevalence >= 0.05 AND delta > 0.00001),
raw AS (SELECT *, p * n_species / count(*) OVER (PARTITION BY cluster ORDER BY p RANGE UNBOUNDED PRECEDING) AS q0 FROM tested),
bh AS (SELECT *, greatest(0, least(1, min(q0) OVER (PARTITION BY cluster ORDER BY p DESC RANGE UNBOUNDED PRECEDING))) AS q FROM raw),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY cluster ORDER BY round(q, 12), round(delta, 9) DESC, species_id))::INT AS rank FROM bh WHERE q <= 0.05 AND delta > 0.00001)
SELECT cluster, species_id, rank, round(mean_in, 6) AS mean_in, CASE WHEN round(mean_out, 6) = 0 THEN 0 ELSE round(mean_out, 6) END AS mean_out, round(delta, 6) AS delta, round(CASE WHEN n_in > 1 AND n_out > 1 AND pooled > 1e-15 THEN delta / sqrt(pooled) END, 6) AS cohen_d,
  round(p, 6) AS p, round(q, 6) AS q, round(prevalence_in, 6) AS prevalence_in, round(prevalence_out, 6) AS prevalence_out, n_in, n_out FROM ranked WHERE rank <= 40"""
VEC = "vec AS (SELECT vec_id AS id, label::BIGINT AS cluster, embedding::DOUBLE[] AS v FROM embeddings)"
PAIRS = f"{VEC}, pairs AS (SELECT a.id AS i, b.id AS j, a.cluster AS ci, b.cluster AS cj, list_distance(a.v, b.v) AS d FROM vec a JOIN vec b ON a.id <> b.id)"
KNN = f"""{VEC}, near AS (SELECT a.id AS src, b.id AS dst, CASE WHEN a.id = b.id THEN 0 ELSE round(list_distance(a.v, b.v), 6) END AS d FROM vec a, vec b),
knn AS (SELECT src, dst, d FROM near QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 15)"""


def _symmetric(source: str, how: str) -> str:
    value = {"max": "max(w)", "mean": "sum(w) / 2", "min": "min(w)"}[how]
    having = " HAVING count(DISTINCT way) = 2" if how == "min" else ""
    return f"(SELECT src, dst, {value} AS w FROM (SELECT src, dst, w, 0 AS way FROM {source} UNION ALL SELECT dst, src, w, 1 FROM {source}) GROUP BY src, dst{having})"


RECIPROCAL = f"{KNN}, raw_w AS (SELECT src, dst, 1 / (1 + d) + {expr.FLOOR} AS w FROM knn), sim AS {_symmetric('raw_w', 'mean')}"
GROUPS = "groups AS (SELECT id AS node, cluster AS label FROM vec)"
STRENGTH = "link AS (SELECT l1.label AS la, l2.label AS lb, sum(w) AS sum_w, count(*) AS n FROM sim JOIN groups l1 ON src = l1.node JOIN groups l2 ON dst = l2.node GROUP BY ALL)"


def _series(coefficients, a: str, b: str, f: str, g: str, sign: str) -> str:
    return "".join(f" {sign} ({c!r}) * {f}({2 * k} * {a}) * {g}({2 * k} * {b})" for k, c in enumerate(coefficients, 1))


def _project() -> str:
    e, radius, forward, _ = expr._series()
    return f"""WITH {LOC}, t AS (SELECT key, radians(lon - {expr.MERIDIAN}) AS lam, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t FROM loc),
x AS (SELECT key, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT key, round({expr.SCALE * radius!r} * (xi{_series(forward, 'xi', 'eta', 'sin', 'cosh', '+')}), 3) AS north, round({expr.SCALE * radius!r} * (eta{_series(forward, 'xi', 'eta', 'cos', 'sinh', '+')}) + {expr.FALSE_EASTING}, 3) AS east FROM x"""


def _unproject() -> str:
    e, radius, _, back = expr._series()
    steps = ", ".join(f"p{k} AS (SELECT *, asin(tanh(atanh(sin(chi)) + {e!r} * atanh({e!r} * sin({'chi' if k == 0 else f'phi{k - 1}'})))) AS phi{k} FROM {'chi' if k == 0 else f'p{k - 1}'})" for k in range(5))
    return f"""WITH {LOC}, x AS (SELECT key, n / {expr.SCALE * radius!r} AS xi, (e - {expr.FALSE_EASTING}) / {expr.SCALE * radius!r} AS eta FROM loc),
y AS (SELECT key, xi{_series(back, 'xi', 'eta', 'sin', 'cosh', '-')} AS x, eta{_series(back, 'xi', 'eta', 'cos', 'sinh', '-')} AS y FROM x),
chi AS (SELECT key, x, y, asin(sin(x) / cosh(y)) AS chi FROM y), {steps}
SELECT key, round(degrees(phi4), 7) AS lat, round(degrees(atan2(sinh(y), cos(x))) + {expr.MERIDIAN}, 7) AS lon FROM p4"""


def _interval(n: str = "n") -> str:
    return f"round(CASE WHEN {n} > 1 THEN mean - 1.96 * sd / sqrt({n}) END, 6) AS ci_low, round(CASE WHEN {n} > 1 THEN mean + 1.96 * sd / sqrt({n}) END, 6) AS ci_high"


ORACLES = {
    "hellinger_cells": f'WITH {PRESENCE}, {LOC}, {CELLS}, {COUNTS} SELECT cell_id, species_id, round(sqrt("count"::DOUBLE / sum("count") OVER (PARTITION BY cell_id)), 6) AS value FROM counts',
    "cell_counts": f"WITH {PRESENCE}, {LOC}, {CELLS}, {COUNTS} SELECT * FROM counts",
    "cell_centroids": f"WITH {LOC}, {CELLS} SELECT cell_id, gx, gy, round(avg(n), 6) AS n_centroid, round(avg(e), 6) AS e_centroid, count(*) AS n_localities FROM cells GROUP BY cell_id, gx, gy",
    "cell_order": f"WITH {LOC}, {CELLS} SELECT cell_id, (row_number() OVER (ORDER BY min(key), cell_id) - 1)::INT AS cell_no FROM cells GROUP BY cell_id",
    "cell_rects": f"WITH {LOC}, {CELLS} SELECT cell_id, (gx * 10000)::DOUBLE AS x0, (gy * 10000)::DOUBLE AS y0, 10000::DOUBLE AS width, 10000::DOUBLE AS height, ((dense_rank() OVER (ORDER BY gx) - 1) % 20)::INT AS colour_idx FROM (SELECT DISTINCT cell_id, gx, gy FROM cells)",
    "missing_coordinates": f"WITH {LOC}, g AS (SELECT floor(coalesce(CASE WHEN key % 11 <> 0 THEN e END, -1) / 10000)::BIGINT AS gx, floor(coalesce(CASE WHEN key % 13 <> 0 THEN n END, -1) / 10000)::BIGINT AS gy FROM loc) SELECT 'gx' || gx || '_gy' || gy AS cell_id, gx, gy, count(*) AS n FROM g GROUP BY ALL",
    "vocab_index": f"WITH {PRESENCE} SELECT (row_number() OVER (ORDER BY species_id) - 1)::INT AS col_index, species_id FROM (SELECT DISTINCT species_id FROM presence)",
    "species_index": f"WITH {PRESENCE}, i AS (SELECT (row_number() OVER (ORDER BY species_id) - 1)::INT AS col_index, species_id FROM (SELECT DISTINCT species_id FROM presence)) SELECT col_index, species_id, coalesce(p_name, species_id) AS species FROM i LEFT JOIN part ON species_id = p_partkey::VARCHAR AND p_partkey % 3 <> 0",
    "explode_ids": "SELECT l_partkey::VARCHAR AS species_id, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1",
    "exclude_ids": f"WITH {PRESENCE} SELECT species_id, count(*) AS n FROM presence WHERE species_id NOT IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size > 25) GROUP BY 1",
    "focal_filter": "SELECT l_partkey::VARCHAR AS taxon, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (l_partkey IN (7, 77, 177) OR p_brand = 'Brand#11') AND p_size < 40 GROUP BY ALL",
    "associate_filter": "SELECT sci, count(*) AS n, count(DISTINCT l_partkey) AS n_taxa FROM (SELECT l_partkey, CASE WHEN p_size > 3 THEN p_brand END AS sci FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 4 <> 0 AND l_partkey % 10 <> 0) WHERE sci IS NULL OR sci NOT IN ('Brand#11', 'Brand#22') GROUP BY sci",
    "taxon_regex": "WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'urn:lsid:x:Taxon:' ELSE 'x' END || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN 'z' ELSE '' END AS t FROM part) SELECT p_partkey, nullif(regexp_extract(t, '(\\d+)$', 1), '') AS loose, nullif(regexp_extract(t, ':Taxon:(\\d+)$', 1), '') AS \"strict\" FROM t",
    "numeric_coerce": "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS value, round_even(c_custkey / 2, 0)::BIGINT AS half FROM customer",
    "locality_key": f"WITH {LOC} SELECT key, CASE WHEN key % 3 = 0 THEN 'L' || key WHEN key % 2 = 0 THEN 'place_' || key ELSE format('cell_{{:.3f}}_{{:.3f}}', lat, lon) END AS locality FROM loc",
    "names_cleaned": r"SELECT p_partkey, regexp_replace(replace(p_name || '/Å-' || p_brand, ' ', '_'), '[^A-Za-z0-9_.åäöÅÄÖ-]', '', 'g') AS file_name, regexp_replace(p_brand, '[^\p{L}\p{N}_-]', '_', 'g')[1:120] AS label_name, p_name || '/Å-' || p_brand AS stripped, p_partkey::VARCHAR AS canonical FROM part",
    "box_filter": f"WITH {LOC} SELECT sci, count(*) AS n, min(lat) AS south, max(lat) AS north FROM loc WHERE key % 17 <> 0 AND lon BETWEEN 11 AND 20 AND lat BETWEEN 56 AND 68 GROUP BY sci",
    "dedup_first": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1",
    "locality_median": """WITH r AS (SELECT l_returnflag AS file, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS row_, o_custkey::VARCHAR AS locality_id, l_partkey AS sp, CASE WHEN l_orderkey % 3 <> 0 THEN 'LAT' || (l_orderkey % 4) END AS latband,
  CASE WHEN l_orderkey % 7 <> 0 THEN (l_orderkey % 1000)::DOUBLE END AS n, (l_suppkey % 50)::DOUBLE AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
once AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY file, locality_id, sp ORDER BY row_) = 1),
bands AS (SELECT locality_id, coalesce(latband, 'NA') AS latband FROM r QUALIFY row_number() OVER (PARTITION BY locality_id ORDER BY file, row_) = 1)
SELECT bands.locality_id, latband, m.n, m.e FROM bands LEFT JOIN (SELECT locality_id, quantile_cont(n, 0.5) AS n, quantile_cont(e, 0.5) AS e FROM once WHERE n IS NOT NULL GROUP BY 1) m ON m.locality_id = bands.locality_id""",
    "project_sweref": _project(),
    "unproject_sweref": _unproject(),
    "radius_join": f"WITH {HITS} SELECT sci, fid, tid, pid, d2 FROM hits",
    "radius_counts": f"WITH {HITS} SELECT sci, tid, count(*) AS n FROM hits GROUP BY ALL",
    "assoc_threshold": f"WITH {HITS}, {KEPT}, {RED} SELECT sci, string_agg(tid, ' ' ORDER BY tid) AS unique_finds, string_agg(tid, ' ' ORDER BY tid) FILTER (WHERE tid IN (SELECT id FROM red)) AS red_finds FROM kept GROUP BY sci",
    "target_totals": f"WITH {HITS}, {KEPT}, {RED} SELECT s.sci, s.n AS n_focal, coalesce(k.n, 0) AS n_kept, coalesce(k.r, 0) AS n_red FROM (SELECT sci, count(*) AS n FROM sites GROUP BY 1) s LEFT JOIN (SELECT sci, count(*) AS n, count(*) FILTER (WHERE tid IN (SELECT id FROM red)) AS r FROM kept GROUP BY 1) k ON s.sci = k.sci",
    "all_observations": f"WITH {HITS}, {KEPT} SELECT sci, tid, n FROM kept",
    "site_species_sets": f"WITH {HITS} SELECT s.sci, s.fid, 'site_' || s.fid AS \"LocalityID\", s.n::INT AS \"SWEREF_N\", s.e::INT AS \"SWEREF_E\", 'LAT1' AS latband, coalesce(string_agg(DISTINCT h.tid, ' ' ORDER BY h.tid), '') AS \"Species_IDs\" FROM sites s LEFT JOIN hits h ON h.sci = s.sci AND h.fid = s.fid GROUP BY s.sci, s.fid, s.n, s.e",
    "red_per_locality": f"WITH {HITS}, {RED} SELECT sci, locality, count(DISTINCT tid) AS n_red FROM hits WHERE tid IN (SELECT id FROM red) GROUP BY ALL",
    "red_lists": f"WITH {HITS}, {RED} SELECT sci, replace(locality, ' ', '_') AS \"LocalityID\", round_even(quantile_cont(n, 0.5), 0)::INT AS \"SWEREF_N\", round_even(quantile_cont(e, 0.5), 0)::INT AS \"SWEREF_E\", string_agg(DISTINCT tid, ' ' ORDER BY tid) AS \"Species_IDs\" FROM hits WHERE tid IN (SELECT id FROM red) GROUP BY sci, locality",
    "latbands": f"WITH {LOC}, q AS (SELECT sci, list_sort(list_distinct(quantile_cont(lat, [{', '.join(str(i / 10) for i in range(11))}]))) AS edges FROM loc GROUP BY 1), b AS (SELECT key, sci, greatest(len(list_filter(edges, lambda x: x < lat)) - 1, 0)::INT AS band FROM loc JOIN q USING (sci)) SELECT key, sci, band, 'LAT' || (band + 1) AS latband FROM b",
    "site_quota": f"WITH {LOC} SELECT sci, count(*) AS n, (CASE WHEN count(*) > 400 THEN 40 ELSE greatest(1, count(*) // 10) END)::INT AS quota FROM loc GROUP BY 1",
    "strict_equal_counts": f"WITH {LOC}, q AS (SELECT sci, list_distinct(quantile_cont(lat, [{', '.join(str(i / 10) for i in range(11))}])) AS edges FROM loc GROUP BY 1), b AS (SELECT sci, 'LAT' || (greatest(len(list_filter(edges, lambda x: x < lat)) - 1, 0) + 1) AS latband FROM loc JOIN q USING (sci)), s AS (SELECT sci, latband, count(*) AS n FROM b GROUP BY ALL) SELECT sci, latband, least(40, min(n) OVER (PARTITION BY sci)) AS n FROM s",
    "pair_distances": f"WITH {COMM}, dots AS (SELECT a.cell_id AS i, b.cell_id AS j, sum(a.value * b.value) AS dot FROM f a JOIN f b ON a.species_id = b.species_id AND a.cell_id < b.cell_id GROUP BY ALL) SELECT a.cell_id AS i, b.cell_id AS j, round(sqrt(greatest(0, 2 - 2 * coalesce(dot, 0))), 6) AS d FROM labels a JOIN labels b ON a.cell_id < b.cell_id LEFT JOIN dots ON i = a.cell_id AND j = b.cell_id",
    "knn_graph": f"WITH {KNN} SELECT * FROM knn",
    "similarity_adaptive": f"""WITH {KNN}, g AS (SELECT median(d) AS g FROM knn), s AS (SELECT src, CASE WHEN median(d) > 0 THEN median(d) ELSE any_value(g) END AS s FROM knn, g GROUP BY src),
raw_w AS (SELECT k.src, k.dst, exp(-d * d / (2 * a.s * b.s)) + {expr.FLOOR} AS w FROM knn k JOIN s a ON a.src = k.src JOIN s b ON b.src = k.dst), sim AS {_symmetric('raw_w', 'max')},
hop AS (SELECT a.src, b.dst, 0.02 * sum(a.w * b.w) AS w FROM sim a JOIN sim b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY ALL), both_ AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM sim UNION ALL SELECT * FROM hop) GROUP BY ALL)
SELECT src, dst, round(w, 6) AS w FROM {_symmetric('both_', 'max')}""",
    "similarity_reciprocal": f"WITH {KNN}, raw_w AS (SELECT src, dst, 1 / (1 + d) + {expr.FLOOR} AS w FROM knn) SELECT src, dst, round(w, 6) AS w FROM {_symmetric('raw_w', 'max')}",
    "similarity_exp": f"WITH {KNN}, raw_w AS (SELECT src, dst, exp(-1.5 * d) + {expr.FLOOR} AS w FROM knn) SELECT src, dst, round(w, 6) AS w FROM {_symmetric('raw_w', 'min')}",
    "edge_topk": f"WITH {RECIPROCAL}, r AS (SELECT src, dst, round(w, 9) AS w FROM sim), top AS (SELECT * FROM r WHERE w >= 0.1 ORDER BY w DESC, src, dst LIMIT 100000) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(w), 6) AS w FROM top WHERE src <> dst GROUP BY least(src, dst), greatest(src, dst)",
    "cluster_centroids": f"WITH {COMM} SELECT cluster, species_id, round(sum(value) / any_value(n), 6) AS value FROM f JOIN labels USING (cell_id) JOIN (SELECT cluster, count(*) AS n FROM labels GROUP BY 1) USING (cluster) GROUP BY cluster, species_id",
    "closest_pair": f"WITH {VEC}, c AS (SELECT cluster, d, avg(v[d]) AS x FROM vec, range(1, 65) t(d) GROUP BY ALL), p AS (SELECT a.cluster AS a, b.cluster AS b, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS dist FROM c a JOIN c b ON a.d = b.d AND a.cluster < b.cluster GROUP BY ALL) SELECT * FROM p ORDER BY dist, a, b LIMIT 1",
    "cluster_links": f"WITH {RECIPROCAL}, {GROUPS}, {STRENGTH} SELECT la, lb, round(sum_w, 6) AS sum_w, n FROM link",
    "modularity": f"""WITH {RECIPROCAL}, {GROUPS}, e AS (SELECT src, dst, w, l1.label AS ls, l2.label AS ld FROM sim JOIN groups l1 ON src = l1.node JOIN groups l2 ON dst = l2.node), m AS (SELECT sum(w) AS m FROM e),
k AS (SELECT ls, sum(2 * w) AS k, coalesce(sum(w) FILTER (WHERE ls = ld), 0) AS win FROM e GROUP BY 1) SELECT round(sum(win / m - pow(k / (2 * m), 2)), 6) AS quality FROM k, m""",
    "label_compaction": "SELECT (dense_rank() OVER (ORDER BY c_nationkey) - 1)::INT AS label, count(*) AS n FROM customer GROUP BY c_nationkey",
    "marker_means": f"WITH {SUMMARY} SELECT cluster, species_id, round(mean_in, 6) AS mean_in, round(mean_out, 6) AS mean_out, round(delta, 6) AS delta, round(prevalence_in, 6) AS prevalence_in, round(prevalence_out, 6) AS prevalence_out, round(prevalence, 6) AS prevalence, n_in, n_out FROM m",
    "marker_cohen_d": f"""WITH {SUMMARY}, v AS (SELECT *, ((n_in - 1) * ((q_in - s_in * s_in / n_in) / (n_in - 1)) + (n_out - 1) * ((q_all - q_in - (s_all - s_in) * (s_all - s_in) / n_out) / (n_out - 1))) / (n_in + n_out - 2) AS pooled FROM m WHERE true)
SELECT cluster, species_id, round(CASE WHEN n_in > 1 AND n_out > 1 AND pooled > 1e-15 THEN delta / sqrt(pooled) END, 6) AS cohen_d FROM v""",
    "marker_mwu": f"WITH {MWU} SELECT cluster, species_id, n_in, n_out, round(u, 6) AS u, round(z, 6) AS z FROM mwu",
    "bh_fdr": f"WITH {BH} SELECT * FROM bh",
    "marker_scan": SCAN,
    "stratified_sample": f"WITH {BANDS}, one AS (SELECT *, {_uniform(43, 'key')} AS u FROM b QUALIFY row_number() OVER (PARTITION BY sci, latband ORDER BY {_uniform(42, 'key')}, key) <= 40) SELECT sci, latband, key FROM one QUALIFY row_number() OVER (PARTITION BY sci ORDER BY u, key) <= 400",
    "weighted_draw": f"WITH w AS (SELECT c_mktsegment, c_custkey, greatest(coalesce(c_acctbal, 0), 0) AS w, {_uniform(42, 'c_custkey')} AS u FROM customer), t AS (SELECT *, sum(w) OVER (PARTITION BY c_mktsegment) AS t FROM w), o AS (SELECT *, CASE WHEN t <= 0 THEN u WHEN w > 0 THEN -ln(u) / w END AS o FROM t) SELECT c_mktsegment, c_custkey FROM o WHERE o IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY o, c_custkey) <= 25",
    "effort_quotas": f"WITH {BANDS} SELECT sci, latband, 42 AS n, count(DISTINCT cluster) AS strata FROM b GROUP BY ALL",
    "separation_matrix": f"WITH {PAIRS}, m AS (SELECT ci, cj, avg(d) AS mean FROM pairs WHERE ci <> cj GROUP BY ALL), c AS (SELECT DISTINCT ci AS c FROM m) SELECT x.c AS cluster, 'C' || y.c AS other, round(mean, 6) AS mean FROM c x CROSS JOIN c y LEFT JOIN m ON ci = x.c AND cj = y.c",
    "marker_topn": f"WITH {SUMMARY} SELECT cluster, species_id, (row_number() OVER (PARTITION BY cluster ORDER BY round(delta, 9) DESC, species_id))::INT AS rank, round(delta, 6) AS delta FROM m WHERE delta > 0.00001 AND prevalence >= 0.05 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(delta, 9) DESC, species_id) <= 40",
    "volcano": f"WITH {BH} SELECT cluster, species_id, round(-log10(least(greatest(q, 1e-300), 1)), 6) AS neglog10q, q <= 0.05 AS significant FROM bh",
    "dispersion": f"""WITH {COMM}, c AS (SELECT cluster, species_id, sum(value) / any_value(n) AS m FROM f JOIN labels USING (cell_id) JOIN (SELECT cluster, count(*) AS n FROM labels GROUP BY 1) USING (cluster) GROUP BY cluster, species_id),
d AS (SELECT l.cluster, l.cell_id, sqrt(sum((coalesce(f.value, 0) - c.m) * (coalesce(f.value, 0) - c.m))) AS d FROM labels l JOIN c ON c.cluster = l.cluster LEFT JOIN f ON f.cell_id = l.cell_id AND f.species_id = c.species_id GROUP BY ALL),
s AS (SELECT cluster, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM d GROUP BY 1) SELECT cluster, n, round(mean, 6) AS mean, round(sd, 6) AS sd, {_interval()} FROM s""",
    "separation": f"WITH {PAIRS}, s AS (SELECT ci, cj, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM pairs WHERE ci < cj GROUP BY ALL) SELECT ci, cj, n, round(mean, 6) AS mean, round(sd, 6) AS sd, {_interval()} FROM s",
    "silhouette": f"""WITH {PAIRS}, m AS (SELECT i, ci, cj, avg(d) AS m FROM pairs GROUP BY ALL), ab AS (SELECT i, ci, max(m) FILTER (WHERE ci = cj) AS a, min(m) FILTER (WHERE ci <> cj) AS b FROM m GROUP BY ALL),
s AS (SELECT ci AS cluster, CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)
SELECT cluster, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS "median", round(min(s), 6) AS "min", round(max(s), 6) AS "max", count(*) AS n, round(avg((s < 0)::INT), 6) AS prop_negative FROM s GROUP BY cluster""",
    "permanova_f": f"""WITH {PAIRS}, n AS (SELECT count(*) AS n, count(DISTINCT cluster) AS k FROM vec), sizes AS (SELECT cluster, count(*) AS m FROM vec GROUP BY 1),
t AS (SELECT sum(d * d) / any_value(n) AS sst FROM pairs, n WHERE i < j), w AS (SELECT sum(d * d / m) AS ssw FROM pairs JOIN sizes ON cluster = ci WHERE i < j AND ci = cj)
SELECT n, k, round(sst, 6) AS sst, round(ssw, 6) AS ssw, round(((sst - ssw) / (k - 1)) / (ssw / (n - k)), 6) AS f, round((sst - ssw) / sst, 6) AS r2 FROM n, t, w""",
    "lcbd": f"""WITH {COMM}, n AS (SELECT count(DISTINCT cell_id) AS n FROM f), mu AS (SELECT species_id, sum(value) / any_value(n) AS m FROM f, n GROUP BY 1),
ss AS (SELECT c.cell_id, sum((coalesce(value, 0) - m) * (coalesce(value, 0) - m)) AS ss FROM (SELECT DISTINCT cell_id FROM f) c CROSS JOIN mu LEFT JOIN f ON f.cell_id = c.cell_id AND f.species_id = mu.species_id GROUP BY 1)
SELECT cell_id, round(ss / sum(ss) OVER (), 6) AS lcbd FROM ss""",
    "lcbd_summary": f"""WITH {COMM}, n AS (SELECT count(DISTINCT cell_id) AS n FROM f), mu AS (SELECT species_id, sum(value) / any_value(n) AS m FROM f, n GROUP BY 1),
ss AS (SELECT c.cell_id, sum((coalesce(value, 0) - m) * (coalesce(value, 0) - m)) AS ss FROM (SELECT DISTINCT cell_id FROM f) c CROSS JOIN mu LEFT JOIN f ON f.cell_id = c.cell_id AND f.species_id = mu.species_id GROUP BY 1),
l AS (SELECT cluster, ss / (SELECT sum(ss) FROM ss) AS x FROM ss JOIN labels USING (cell_id))
SELECT cluster, round(avg(x), 9) AS lcbd_mean, round(quantile_cont(x, 0.5), 9) AS lcbd_median, round(stddev_samp(x), 9) AS lcbd_sd, round(min(x), 9) AS lcbd_min, round(max(x), 9) AS lcbd_max FROM l GROUP BY 1""",
    "indval_summary": f"""WITH {SUMMARY}, e AS (SELECT cluster, round(delta, 9) AS d, CASE WHEN round(delta, 9) > 0 THEN round(delta, 9) END AS pos FROM m)
SELECT cluster, count(*) AS n_candidate_species, count(pos) AS n_indicator_species, round(sum(pos), 6) AS sum_effect, round(avg(pos), 6) AS mean_effect, round(quantile_cont(pos, 0.5), 6) AS median_effect, round(count(pos) / count(*), 6) AS prop_indicator_species FROM e GROUP BY 1""",
    "sorensen": f"""WITH {COMM}, own AS (SELECT * FROM f JOIN labels USING (cell_id)), k AS (SELECT cluster, cell_id, count(*) AS k FROM own GROUP BY ALL),
a AS (SELECT x.cell_id AS i, y.cell_id AS j, count(*) AS a FROM own x JOIN own y ON x.cluster = y.cluster AND x.species_id = y.species_id AND x.cell_id < y.cell_id GROUP BY ALL),
p AS (SELECT x.cluster, coalesce(a.a, 0)::DOUBLE AS a, x.k - coalesce(a.a, 0)::DOUBLE AS b, y.k - coalesce(a.a, 0)::DOUBLE AS c FROM k x JOIN k y ON x.cluster = y.cluster AND x.cell_id < y.cell_id LEFT JOIN a ON a.i = x.cell_id AND a.j = y.cell_id),
s AS (SELECT cluster, CASE WHEN 2 * a + b + c > 0 THEN (b + c) / (2 * a + b + c) ELSE 0 END AS sor, CASE WHEN a + least(b, c) > 0 THEN least(b, c) / (a + least(b, c)) ELSE 0 END AS sim FROM p),
n AS (SELECT cluster, count(*) AS n_cells FROM labels GROUP BY 1)
SELECT cluster, count(*) AS n_pairs_used, any_value(n_cells) AS n_cells, round(avg(sor), 6) AS beta_sor_mean, round(stddev_samp(sor), 6) AS beta_sor_sd, round(avg(sim), 6) AS beta_turnover_mean, round(stddev_samp(sim), 6) AS beta_turnover_sd, round(avg(sor - sim), 6) AS beta_nestedness_mean, round(stddev_samp(sor - sim), 6) AS beta_nestedness_sd FROM s JOIN n USING (cluster) GROUP BY cluster""",
    "minmax": "WITH m AS (SELECT c_custkey, c_acctbal AS x, min(c_acctbal) OVER (PARTITION BY c_mktsegment) AS lo, max(c_acctbal) OVER (PARTITION BY c_mktsegment) AS hi FROM customer) SELECT c_custkey, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.5 END, 6) AS scaled FROM m",
    "quantile_clamp": "WITH q AS (SELECT quantile_cont(c_acctbal, 0.005) AS lo, quantile_cont(c_acctbal, 0.995) AS hi FROM customer) SELECT c_custkey, round(greatest(lo, least(hi, c_acctbal)), 6) AS clamped FROM customer, q",
    "map_cells": f"WITH {LOC}, {CELLS}, r AS (SELECT cell_id, gx, gy, min(cluster) AS cluster FROM cells GROUP BY ALL) SELECT cell_id, cluster, (gx * 10000)::DOUBLE AS x0, (gy * 10000)::DOUBLE AS y0, 10000::DOUBLE AS width, 10000::DOUBLE AS height, ((dense_rank() OVER (ORDER BY cluster) - 1) % 20)::INT AS colour_idx FROM r",
    "map_extent": f"""WITH {LOC}, {CELLS}, e AS (SELECT min(gx) * 10000 AS xl, (max(gx) + 1) * 10000 AS xh, min(gy) * 10000 AS yl, (max(gy) + 1) * 10000 AS yh FROM cells)
SELECT xl::DOUBLE AS x_low, xh::DOUBLE AS x_high, yl::DOUBLE AS y_low, yh::DOUBLE AS y_high, array_to_string(list_transform(range(ceil(xl / 100000)::BIGINT, floor(xh / 100000)::BIGINT + 1), lambda i: i * 100000), ' ') AS x_ticks, array_to_string(list_transform(range(ceil(yl / 100000)::BIGINT, floor(yh / 100000)::BIGINT + 1), lambda i: i * 100000), ' ') AS y_ticks FROM e""",
    "strip_values": f"""WITH {SUMMARY}, top AS (SELECT cluster, species_id FROM m WHERE delta > 0.00001 AND prevalence >= 0.05 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(delta, 9) DESC, species_id) <= 12)
SELECT top.cluster, top.species_id, l.cell_id, l.cluster = top.cluster AS inside, round(coalesce(f.value, 0), 6) AS value FROM labels l CROSS JOIN top LEFT JOIN f ON f.cell_id = l.cell_id AND f.species_id = top.species_id""",
    "lcbd_boxes": f"""WITH {COMM}, n AS (SELECT count(DISTINCT cell_id) AS n FROM f), mu AS (SELECT species_id, sum(value) / any_value(n) AS m FROM f, n GROUP BY 1),
ss AS (SELECT c.cell_id, sum((coalesce(value, 0) - m) * (coalesce(value, 0) - m)) AS ss FROM (SELECT DISTINCT cell_id FROM f) c CROSS JOIN mu LEFT JOIN f ON f.cell_id = c.cell_id AND f.species_id = mu.species_id GROUP BY 1),
l AS (SELECT cluster, ss / (SELECT sum(ss) FROM ss) AS x FROM ss JOIN labels USING (cell_id)),
q AS (SELECT cluster, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY 1)
SELECT l.cluster, round(q1, 9) AS q1, round(med, 9) AS "median", round(q3, 9) AS q3, round(min(x), 9) AS low, round(max(x), 9) AS high FROM l JOIN q ON q.cluster = l.cluster WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) GROUP BY l.cluster, q1, med, q3""",
}
ORACLES["radar"] = f"""WITH s AS ({ORACLES['sorensen']}), t AS (SELECT cluster, unnest(['n_cells', 'beta_sor_mean', 'beta_turnover_mean']) AS metric, unnest([n_cells::DOUBLE, beta_sor_mean, beta_turnover_mean]) AS x FROM s)
SELECT cluster, metric, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 0.5 END, 6) AS scaled FROM t WINDOW w AS (PARTITION BY metric)"""
ORACLES["cluster_report"] = f"SELECT * FROM ({ORACLES['lcbd_summary']}) LEFT JOIN ({ORACLES['sorensen']}) USING (cluster) LEFT JOIN ({ORACLES['indval_summary']}) USING (cluster)"
