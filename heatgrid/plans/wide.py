"""Spatial queries over grids and zones that grow with the tables: about 600 cells of ``lst_wide`` for each 1,000 line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators import spatial as op
from heatgrid.plans.spatial import DIST, GI, TIER, WEIGHTED, weighted, inside
from heatgrid.registry import query
from heatgrid.sources import standins

standins.SQL |= {
    "lst_wide": "SELECT CAST(floor(l_partkey / 8) AS INT) AS row, CAST(floor(l_orderkey / 1024) AS INT) AS col, sum(l_quantity) / count(*) AS value FROM {lineitem} GROUP BY 1, 2",
    "lc_wide": "SELECT CAST(floor(l_partkey / 8) AS INT) AS row, CAST(floor(l_orderkey / 1024) AS INT) AS col, CASE min(l_suppkey) % 5 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 50 WHEN 3 THEN 80 ELSE 0 END AS code FROM {lineitem} GROUP BY 1, 2",
    "zones_wide": """SELECT 's' || CAST(s_suppkey AS STRING) AS feature_id, 1 AS part, 1 AS ring, seq, x0 + a AS x1, y0 + b AS y1, x0 + c AS x2, y0 + d AS y2 FROM (SELECT s_suppkey, CAST(s_suppkey % 48 * 12 AS DOUBLE) AS x0, CAST(floor(s_suppkey / 48) * 12 AS DOUBLE) AS y0 FROM {supplier}) q,
      (VALUES (1, 0, 0, 10, 0), (2, 10, 0, 10, 10), (3, 10, 10, 0, 10), (4, 0, 10, 0, 0)) AS e(seq, a, b, c, d)""",
    "points_wide": "SELECT c_custkey AS id, CAST(floor(c_custkey / 6) AS INT) AS row, CAST(c_custkey * 7 % 586 AS INT) AS col FROM {customer}",
}


def _wide(sql: str) -> str:
    return sql.replace("{lst}", "{lst_wide}").replace("{lc}", "{lc_wide}").replace("{zones}", "{zones_wide}").replace("{some_zones}", "{zones_wide}")


query("j1_cells_in_zones_wide", "lst_wide zones_wide", f"SELECT feature_id, row, col, value, 1 AS weight FROM ({_wide(inside('lst', 'zones', 'value'))})")(op.cells_in_zones)
query("j3_distance_bands_wide", "lst_wide zones_wide", _wide(f"""SELECT d.feature_id, d.row, d.col, greatest(1, ceil(round(d / 2, 9))) * 2.0 AS distance_m FROM ({DIST}) d
ANTI JOIN ({inside('lst', 'zones', 'value')}) i ON i.feature_id = d.feature_id AND i.row = d.row AND i.col = d.col WHERE d <= 6"""))(
    lambda lst, z: op.distance_bands(lst, z, 2, 6).select("feature_id", "row", "col", "distance_m"))
query("x1_local_gi_wide", "lst_wide", _wide(f"SELECT row, col, value, round(z, 4) AS z FROM ({GI})"))(lambda lst: op.local_gi(lst).withColumn("z", F.round("z", 4)))
query("x1_local_gi_band_wide", "lst_wide", _wide(f"SELECT row, col, value, round(z, 4) AS z FROM ({GI.replace('<= 2.25', '<= 64')})"))(lambda lst: op.local_gi(lst, 8.0).withColumn("z", F.round("z", 4)))
query("q2_heat_islands_wide", "lst_wide", _wide(f"SELECT tier, count(*) AS n FROM (SELECT {TIER} AS tier FROM ({GI})) GROUP BY tier"))(lambda lst: op.classify_clusters(op.local_gi(lst)).groupBy("tier").agg(F.count("*").alias("n")))
query("a1_zonal_statistics_wide", "lst_wide zones_wide", _wide(f"""SELECT feature_id, round(avg(value), 4) AS mean, round(median(value), 4) AS median, min(value) AS min, max(value) AS max, count(value) AS count
FROM (SELECT DISTINCT feature_id FROM {{zones}} z) LEFT JOIN ({inside('lst', 'zones', 'value')}) USING (feature_id) GROUP BY 1"""))(
    lambda lst, z: op.zonal_statistics(lst, z).select("feature_id", "min", "max", "count", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median")))
query("a1_zonal_weighted_wide", "lst_wide zones_wide", _wide(WEIGHTED))(weighted)
query("w5_buffer_fractions_wide", "lc_wide points_wide", """SELECT id, round(count(*) FILTER (code IN (10, 30)) / count(*) FILTER (code <> 0), 5) AS green, round(count(*) FILTER (code = 80) / count(*) FILTER (code <> 0), 5) AS blue
FROM {points_wide} p JOIN {lc_wide} c ON abs(c.row - p.row) <= 3 AND abs(c.col - p.col) <= 3 GROUP BY id HAVING count(*) FILTER (code <> 0) >= 10""")(lambda lc, p: op.buffer_fractions(lc, p, 3, {"green": [10, 30], "blue": [80]}))  # fmt: skip
query("a4_edge_metrics_wide", "lc_wide", """SELECT a.code, count(*) FILTER (a.code = b.code) AS like2, count(*) FILTER (a.code <> b.code) AS unlike FROM {lc_wide} a JOIN {lc_wide} b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row AND b.col = a.col - 1) OR (b.col = a.col AND b.row = a.row + 1) OR (b.col = a.col AND b.row = a.row - 1) GROUP BY 1""")(
    lambda lc: op.neighbours(lc.withColumn("value", F.col("code")), 1.0).groupBy(F.col("value").alias("code")).agg(F.count_if(F.col("value") == F.col("other")).alias("like2"), F.count_if(F.col("value") != F.col("other")).alias("unlike")))
