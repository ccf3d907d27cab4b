"""Queries of the spatial joins, zone statistics and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.operators import spatial as op
from heatgrid.operators import vectors as vec
from heatgrid.operators.coverage import UNIT, covered_cells
from heatgrid.registry import query
from heatgrid.sources import standins

standins.SQL |= {
    # squares, triangles, and squares with a hole
    "zones": """SELECT kind || CAST(k AS STRING) AS feature_id, 1 AS part, ring, seq, x0 + a AS x1, y0 + b AS y1, x0 + c AS x2, y0 + d AS y2 FROM {squares} q, (VALUES
      ('s', 1, 1, 0, 0, 10, 0), ('s', 1, 2, 10, 0, 10, 10), ('s', 1, 3, 10, 10, 0, 10), ('s', 1, 4, 0, 10, 0, 0), ('t', 1, 1, 0, 0, 10, 0), ('t', 1, 2, 10, 0, 0, 10), ('t', 1, 3, 0, 10, 0, 0),
      ('h', 1, 1, 1, 1, 9, 1), ('h', 1, 2, 9, 1, 9, 9), ('h', 1, 3, 9, 9, 1, 9), ('h', 1, 4, 1, 9, 1, 1), ('h', 2, 1, 3, 3, 3, 6), ('h', 2, 2, 3, 6, 6, 6), ('h', 2, 3, 6, 6, 6, 3), ('h', 2, 4, 6, 3, 3, 3)) AS e(kind, ring, seq, a, b, c, d)""",
    "some_zones": "SELECT * FROM {zones} z WHERE feature_id IN ('s6', 't7', 'h12')",
    "boundary": "SELECT * FROM {zones} z WHERE feature_id = 't12'",
    "all_zones": "SELECT * FROM {zones} z UNION ALL SELECT 'far', 1, 1, seq, x1 + 1000, y1, x2 + 1000, y2 FROM {zones} y WHERE feature_id = 's0'",
    "pts": "SELECT c_custkey AS id, CAST(c_custkey % 61 AS DOUBLE) + 0.25 AS x, CAST(c_custkey % 59 AS DOUBLE) + 0.75 AS y FROM {customer}",
    "at_points": "SELECT c_custkey AS id, CAST(c_custkey % 64 AS INT) AS row, CAST(c_custkey * 7 % 64 AS INT) AS col FROM {customer}",
}
#: (feature_id, row, col, value or code) of cells whose centre lies inside, by crossings
IN = """SELECT feature_id, row, col, {v} FROM {src} t JOIN {zones} e ON ((y1 <= row + 0.5) <> (y2 <= row + 0.5)) AND col + 0.5 < x1 + (row + 0.5 - y1) * (x2 - x1) / (y2 - y1)
GROUP BY feature_id, row, col, {v} HAVING count(*) % 2 = 1"""


def inside(src: str, zones: str, v: str) -> str:
    return IN.replace("{src}", "{" + src + "}").replace("{zones}", "{" + zones + "}").replace("{v}", v)


#: (feature_id, row, col, value or code, w) of cells with their covered share, by the mean of what each edge leaves free to its right
COVERED = """SELECT feature_id, row, col, {v}, round(-sum(s * h * CASE WHEN xr > xl THEN ((CASE WHEN xr <= col THEN xr - col WHEN xr >= col + 1 THEN 0.5 ELSE (xr - col) - (xr - col) ** 2 / 2 END) - (CASE WHEN xl <= col THEN xl - col WHEN xl >= col + 1 THEN 0.5 ELSE (xl - col) - (xl - col) ** 2 / 2 END)) / (xr - xl)
  ELSE greatest(0, least(1, col + 1 - xl)) END) * 1e9) / 1e9 AS w FROM (SELECT *, least(xa, xb) AS xl, greatest(xa, xb) AS xr FROM (SELECT feature_id, row, col, {v}, s, least(hi, row + 1) - greatest(lo, row) AS h, x1 + (greatest(lo, row) - y1) / (y2 - y1) * (x2 - x1) AS xa, x1 + (least(hi, row + 1) - y1) / (y2 - y1) * (x2 - x1) AS xb
  FROM {src} t JOIN (SELECT *, least(y1, y2) AS lo, greatest(y1, y2) AS hi, sign(y2 - y1) * CASE WHEN ring = 1 THEN 1 ELSE -1 END * sign(sum(x1 * y2 - x2 * y1) OVER (PARTITION BY feature_id, part, ring)) AS s FROM {zones} z) e ON y1 <> y2 AND hi > row AND lo < row + 1))
GROUP BY feature_id, row, col, {v} HAVING w > 0"""


def covered(src: str, zones: str, v: str) -> str:
    return COVERED.replace("{src}", "{" + src + "}").replace("{zones}", "{" + zones + "}").replace("{v}", v)


def _large(cells):
    """Cells of zones with more than four."""
    return cells.where("code IS NOT NULL").select("feature_id", "row", "col", "code").withColumn("_n", F.count("*").over(W.partitionBy("feature_id"))).where("_n > 4").drop("_n")


DIST = """SELECT feature_id, row, col, value, min(sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2)) AS d FROM (
  SELECT *, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM (SELECT row, col, value, col + 0.5::DOUBLE AS px, row + 0.5::DOUBLE AS py FROM {lst} c) c, {some_zones} e)
GROUP BY feature_id, row, col, value"""

query("j1_cells_in_zones", "lst zones", f"SELECT feature_id, row, col, value, 1 AS weight FROM ({inside('lst', 'zones', 'value')})")(op.cells_in_zones)
query("j2_points_in_polygons", "pts zones", "SELECT id, feature_id FROM {pts} p JOIN {zones} e ON ((y1 <= y) <> (y2 <= y)) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY id, feature_id HAVING count(*) % 2 = 1")(op.points_in_polygons)
query("p8_clip_centroid_within", "zones boundary", """SELECT feature_id FROM (SELECT feature_id, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS x, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS y FROM {zones} z GROUP BY 1) p
JOIN (SELECT x1, y1, x2, y2 FROM {boundary} b) e ON ((y1 <= y) <> (y2 <= y)) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY feature_id HAVING count(*) % 2 = 1""")(
    lambda zones, boundary: op.points_in_polygons(vec.geometry(zones).select(F.col("feature_id").alias("id"), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y")), boundary.withColumn("feature_id", F.lit("b"))).select(F.col("id").alias("feature_id")))
query("j3_distance_bands", "lst zones", f"""SELECT d.feature_id, d.row, d.col, greatest(1, ceil(round(d / 2, 9))) * 2.0 AS distance_m FROM ({DIST.replace('{some_zones}', '{zones}')}) d
ANTI JOIN ({inside('lst', 'zones', 'value')}) i ON i.feature_id = d.feature_id AND i.row = d.row AND i.col = d.col WHERE d <= 6""")(lambda lst, z: op.distance_bands(lst, z, 2, 6).select("feature_id", "row", "col", "distance_m"))
query("j3_distance_bands_whole", "lst zones", f"""SELECT d.feature_id, d.row, d.col, greatest(1, ceil(round(d / 2, 9))) * 2.0 AS distance_m FROM ({DIST.replace('{some_zones}', '{zones}')}) d
ANTI JOIN ({inside('lst', 'zones', 'value')}) i ON i.feature_id = d.feature_id AND i.row = d.row AND i.col = d.col WHERE d <= 6""")(lambda lst, z: op.distance_bands(lst, z, 2, 6).select("feature_id", "row", "col", "distance_m"))
query("p9_crop_to_boundary", "lst boundary", f"""SELECT DISTINCT row, col, value FROM (SELECT row, col, value FROM ({inside('lst', 'boundary', 'value')}) UNION ALL SELECT row, col, value FROM ({DIST.replace('{some_zones}', '{boundary}')}) WHERE d <= 4)""")(
    lambda lst, b: op.crop(lst, b, 4))
query("j4_neighbours_within", "lst", "SELECT a.row, a.col, a.value, sum(b.value) AS total, count(*) AS n FROM {lst} a JOIN {lst} b ON (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 2.25 AND NOT (a.row = b.row AND a.col = b.col) GROUP BY ALL")(
    lambda lst: op.neighbours(lst, 1.5).groupBy("row", "col", "value").agg(F.sum("other").alias("total"), F.count("*").alias("n")))
query("j5_knn", "lst", """SELECT row, col, n_row, n_col, d2 FROM (SELECT a.row, a.col, b.row AS n_row, b.col AS n_col, (a.row - b.row) ** 2 + (a.col - b.col) ** 2 AS d2, row_number() OVER (PARTITION BY a.row, a.col ORDER BY (a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.row, b.col) AS k
FROM {lst} a JOIN {lst} b ON NOT (a.row = b.row AND a.col = b.col)) WHERE k <= 8""")(op.knn)  # fmt: skip
query("j5_knn_whole", "lst", """SELECT row, col, n_row, n_col, d2 FROM (SELECT a.row, a.col, b.row AS n_row, b.col AS n_col, (a.row - b.row) ** 2 + (a.col - b.col) ** 2 AS d2, row_number() OVER (PARTITION BY a.row, a.col ORDER BY (a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.row, b.col) AS k
FROM {lst} a JOIN {lst} b ON NOT (a.row = b.row AND a.col = b.col)) WHERE k <= 8""")(op.knn)  # fmt: skip
GI = """SELECT row, col, value, (l - w * m) / sqrt(((q - value * value) / (n - 1) - m * m) * ((n - 1) * w - w * w) / (n - 2)) AS z FROM (SELECT *, (s - value) / (n - 1) AS m FROM (
  SELECT *, count(*) OVER () AS n, sum(value) OVER () AS s, sum(value * value) OVER () AS q FROM (
  SELECT a.row, a.col, a.value, count(*)::DOUBLE AS w, sum(b.value) AS l FROM {lst} a JOIN {lst} b ON (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 2.25 AND NOT (a.row = b.row AND a.col = b.col) GROUP BY ALL)))"""
GI_STAR = """SELECT row, col, value, (l + value - (w + 1) * s / n) / sqrt((q / n - (s / n) ** 2) * (n * (w + 1) - (w + 1) ** 2) / (n - 1)) AS z FROM (
  SELECT *, count(*) OVER () AS n, sum(value) OVER () AS s, sum(value * value) OVER () AS q FROM (
  SELECT a.row, a.col, a.value, count(*)::DOUBLE AS w, sum(b.value) AS l FROM {lst} a JOIN {lst} b ON (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 2.25 AND NOT (a.row = b.row AND a.col = b.col) GROUP BY ALL))"""
TIER = "CASE WHEN z >= 2.5758293 THEN 99 WHEN z <= -2.5758293 THEN -99 WHEN z >= 1.9599640 THEN 95 WHEN z <= -1.9599640 THEN -95 WHEN z >= 1.6448536 THEN 90 WHEN z <= -1.6448536 THEN -90 ELSE 0 END"
_z = lambda df: df.withColumn("z", F.round("z", 4))
query("x1_local_gi", "lst", f"SELECT row, col, value, round(z, 4) AS z FROM ({GI})")(lambda lst: _z(op.local_gi(lst)))
query("x1_local_gi_star", "lst", f"SELECT row, col, value, round(z, 4) AS z FROM ({GI_STAR})")(lambda lst: _z(op.local_gi(lst, include_self=True)))
KNN = """SELECT row, col, n_row, n_col FROM (SELECT a.row, a.col, b.row AS n_row, b.col AS n_col, row_number() OVER (PARTITION BY a.row, a.col ORDER BY (a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.row, b.col) AS k
FROM {lst} a JOIN {lst} b ON NOT (a.row = b.row AND a.col = b.col)) WHERE k <= 8"""
GI_QUEEN = GI[: GI.index("  SELECT a.row")] + f"""  SELECT a.row, a.col, a.value, count(*)::DOUBLE AS w, sum(b.value) AS l FROM ({KNN}) k JOIN {{lst}} a ON a.row = k.row AND a.col = k.col JOIN {{lst}} b ON b.row = k.n_row AND b.col = k.n_col GROUP BY ALL)))"""
query("x1_local_gi_queen", "lst", f"SELECT row, col, value, round(z, 4) AS z FROM ({GI_QUEEN})")(lambda lst: _z(op.local_gi(lst, queen=True)))
query("x2_classify_clusters", "lst", f"SELECT row, col, round(z, 4) AS z, {TIER} AS tier FROM ({GI})")(lambda lst: _z(op.classify_clusters(op.local_gi(lst))).drop("value"))
query("a19_cluster_summary", "lst", f"""SELECT category, confidence, coalesce(n, 0) AS n_cells, round(100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 2) AS pct_valid FROM (VALUES ('hot', 99, 99), ('hot', 95, 95), ('hot', 90, 90), ('cold', 99, -99), ('cold', 95, -95), ('cold', 90, -90), ('not_significant', NULL, 0)) k(category, confidence, tier)
LEFT JOIN (SELECT tier, count(*) AS n FROM (SELECT {TIER} AS tier FROM ({GI})) GROUP BY tier) USING (tier)""")(lambda lst: op.cluster_summary(op.classify_clusters(op.local_gi(lst))))  # fmt: skip
query("a1_zonal_statistics", "lst all_zones", f"""SELECT feature_id, round(s.mean, 4) AS mean, round(s.median, 4) AS median, s.min, s.max, round(s.sum, 4) AS sum, coalesce(s.count, 0) AS count, round(s.stdev, 4) AS stdev, round(s.variance, 4) AS variance, majority
FROM (SELECT DISTINCT feature_id FROM {{all_zones}} z) LEFT JOIN (SELECT feature_id, avg(value) AS mean, median(value) AS median, min(value) AS min, max(value) AS max, sum(value) AS sum, count(*) AS count, stddev_samp(value) AS stdev, var_samp(value) AS variance FROM ({inside('lst', 'all_zones', 'value')}) GROUP BY 1) s USING (feature_id)
LEFT JOIN (SELECT feature_id, arg_max(value, n * 1000 - value) AS majority FROM (SELECT feature_id, value, count(*) AS n FROM ({inside('lst', 'all_zones', 'value')}) GROUP BY ALL) GROUP BY 1) m USING (feature_id)""")(
    lambda lst, z: op.zonal_statistics(lst, z).select("feature_id", "min", "max", "count", "majority", *[F.round(c, 4).alias(c) for c in ("mean", "median", "sum", "stdev", "variance")]))
WEIGHTED = f"""WITH c AS ({covered('lst', 'zones', 'value')}), u AS (SELECT feature_id, value, CAST(round(w * 1e9) AS BIGINT) AS u FROM c), o AS (SELECT *, sum(u) OVER (PARTITION BY feature_id ORDER BY value) AS upto, sum(u) OVER (PARTITION BY feature_id) AS whole FROM u)
SELECT feature_id, round(sum(u) / 1e9, 6) AS count, round(sum(value * u) / sum(u), 6) AS mean, round((min(value) FILTER (2 * upto >= whole) + min(value) FILTER (2 * upto > whole)) / 2, 6) AS median, round(sum(value * u) / 1e9, 6) AS sum, round(sum(value * value * u) / sum(u) - (sum(value * u) / sum(u)) ** 2, 4) AS variance FROM o GROUP BY 1"""
weighted = lambda lst, z: op.zonal_statistics(lst, z, exact=True).where("mean IS NOT NULL").select("feature_id", *[F.round(c, 6).alias(c) for c in ("count", "mean", "median", "sum")], F.round("variance", 4).alias("variance"))
query("a1_zonal_weighted", "lst zones", WEIGHTED)(weighted)
query("j1_coverage", "lst zones", f"SELECT feature_id, row, col, value, round(w, 6) AS share FROM ({covered('lst', 'zones', 'value')})")(
    lambda lst, z: covered_cells(lst, z).select("feature_id", "row", "col", "value", F.round(F.col("units") / UNIT, 6).alias("share")))
query("a2_land_cover_proportions", "lc zones crosswalk", f"""SELECT *, prop_forest + prop_open + prop_built BETWEEN 0.95 AND 1.05 AS row_ok FROM (SELECT feature_id, {', '.join(f"round(coalesce(sum(w) FILTER (target = '{t}'), 0) / sum(w), 4) AS prop_{t}" for t in ('forest', 'open', 'built'))}
FROM ({covered('lc', 'zones', 'code')}) i LEFT JOIN {{crosswalk}} m ON m.code = i.code GROUP BY feature_id)""")(lambda lc, z, m: op.land_cover_proportions(lc, z, m, ["forest", "open", "built"]))  # fmt: skip
GEOM = "SELECT feature_id, round(area, 2) AS area_m2, round(area / 1e4, 4) AS area_ha, round(len, 2) AS perimeter_m FROM (SELECT feature_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS len FROM {zones} z GROUP BY 1)"
query("a3_landscape_metrics", "zones lc lst", f"""SELECT feature_id, round(area_m2 / 1e4, 4) AS PA, perimeter_m AS PP, round(perimeter_m / (2 * sqrt(pi() * area_m2)), 4) AS LSI, LPI, NDVI_veg FROM ({GEOM})
LEFT JOIN (SELECT feature_id, round(100 * max(n) / sum(n), 2) AS LPI FROM (SELECT feature_id, code, count(*) AS n FROM ({inside('lc', 'zones', 'code')}) GROUP BY ALL) GROUP BY 1) USING (feature_id)
LEFT JOIN (SELECT feature_id, round(avg(value / 49 - 0.31::DOUBLE) FILTER (value / 49 - 0.31::DOUBLE > 0.2::DOUBLE), 4) AS NDVI_veg FROM ({inside('lst', 'zones', 'value')}) GROUP BY 1) USING (feature_id)""")(
    lambda z, lc, lst: op.landscape_metrics(vec.geometry(z), z, lc, lst.withColumn("value", F.col("value") / 49 - 0.31)))
query("a4_edge_metrics", "lc", """SELECT code, round(unlike / all_, 4) AS ED, round(100 * like2 / 2 / (2 * s * (s - 1) + CASE WHEN n = s * s THEN 0 WHEN n - s * s <= s THEN 2 * (n - s * s) - 1 ELSE 2 * (n - s * s) - 2 END), 4) AS AI FROM (
  SELECT code, n, floor(sqrt(n)) AS s, sum(n) OVER () AS all_ FROM (SELECT code, count(*) AS n FROM {lc} c GROUP BY 1)) JOIN (
  SELECT a.code, count(*) FILTER (a.code = b.code) AS like2, count(*) FILTER (a.code <> b.code) AS unlike FROM {lc} a JOIN {lc} b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY 1) USING (code)""")(op.edge_metrics)  # fmt: skip
query("a4_patch_metrics", "lc", """WITH RECURSIVE c AS (SELECT row, col, code FROM {lc} t), n AS (SELECT a.row, a.col, b.row AS r2, b.col AS c2 FROM c a JOIN c b ON a.code = b.code AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1),
 w AS (SELECT row, col, row * 100000 + col AS p FROM c UNION SELECT r2, c2, p FROM w JOIN n ON n.row = w.row AND n.col = w.col), l AS (SELECT row, col, min(p) AS p FROM w GROUP BY 1, 2),
 k AS (SELECT a.p, count(*) AS alike FROM l a JOIN l b ON a.p = b.p AND abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY 1),
 s AS (SELECT p, min(code) AS code, count(*) AS n FROM l JOIN c USING (row, col) GROUP BY 1)
 SELECT code, count(*) AS n_patches, round(count(*) / (SELECT count(*) FROM c), 6) AS PD, round(avg((4 * n - coalesce(alike, 0)) / (2 * ceil(2 * sqrt(n)))), 4) AS SHAPE_MN FROM s LEFT JOIN k USING (p) GROUP BY code""")(op.patch_metrics)  # fmt: skip
_BY = f"""WITH RECURSIVE c AS (SELECT feature_id, row, col, code FROM ({inside('lc', 'zones', 'code')}) WHERE feature_id IN (SELECT feature_id FROM ({inside('lc', 'zones', 'code')}) GROUP BY 1 HAVING count(*) > 4))"""
query("a4_edge_metrics_by_zone", "lc zones", _BY + """, p AS (SELECT a.feature_id, a.code, count(*) FILTER (a.code = b.code) AS like2, count(*) FILTER (a.code <> b.code) AS unlike FROM c a JOIN c b ON a.feature_id = b.feature_id AND abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY 1, 2),
 n AS (SELECT feature_id, code, count(*) AS n, floor(sqrt(count(*))) AS s, sum(count(*)) OVER (PARTITION BY feature_id) AS all_ FROM c GROUP BY 1, 2)
 SELECT feature_id, code, round(unlike / all_, 4) AS ED, round(100 * like2 / 2 / nullif(2 * s * (s - 1) + CASE WHEN n = s * s THEN 0 WHEN n - s * s <= s THEN 2 * (n - s * s) - 1 ELSE 2 * (n - s * s) - 2 END, 0), 4) AS AI FROM p JOIN n USING (feature_id, code)""")(
    lambda lc, z: op.edge_metrics(_large(op.cells_in_zones(lc, z)), ("feature_id",)))
query("a4_patch_metrics_by_zone", "lc zones", _BY + """, n AS (SELECT a.feature_id, a.row, a.col, b.row AS r2, b.col AS c2 FROM c a JOIN c b ON a.feature_id = b.feature_id AND a.code = b.code AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
 w AS (SELECT feature_id, row, col, row * 100000 + col AS p FROM c UNION SELECT w.feature_id, r2, c2, p FROM w JOIN n ON n.feature_id = w.feature_id AND n.row = w.row AND n.col = w.col), l AS (SELECT feature_id, row, col, min(p) AS p FROM w GROUP BY 1, 2, 3),
 k AS (SELECT a.feature_id, a.p, count(*) AS alike FROM l a JOIN l b ON a.feature_id = b.feature_id AND a.p = b.p AND abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY 1, 2),
 s AS (SELECT feature_id, p, min(code) AS code, count(*) AS n FROM l JOIN c USING (feature_id, row, col) GROUP BY 1, 2)
 SELECT feature_id, code, count(*) AS n_patches, round(count(*) / sum(sum(n)) OVER (PARTITION BY feature_id), 6) AS PD, round(avg((4 * n - coalesce(alike, 0)) / (2 * ceil(2 * sqrt(n)))), 4) AS SHAPE_MN FROM s LEFT JOIN k USING (feature_id, p) GROUP BY feature_id, code""")(
    lambda lc, z: op.patch_metrics(_large(op.cells_in_zones(lc, z)), ("feature_id",)))
query("w5_buffer_fractions", "lc at_points", """SELECT id, round(count(*) FILTER (code IN (10, 30)) / count(*) FILTER (code <> 0), 5) AS green, round(count(*) FILTER (code = 80) / count(*) FILTER (code <> 0), 5) AS blue
FROM {at_points} p JOIN {lc} c ON abs(c.row - p.row) <= 3 AND abs(c.col - p.col) <= 3 GROUP BY id HAVING count(*) FILTER (code <> 0) >= 10""")(lambda lc, p: op.buffer_fractions(lc, p, 3, {"green": [10, 30], "blue": [80]}))  # fmt: skip
