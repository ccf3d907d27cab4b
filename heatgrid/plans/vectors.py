"""Queries of the vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators import vectors as op
from heatgrid.plans.spatial import GEOM
from heatgrid.registry import query
from heatgrid.sources import standins

standins.SQL |= {
    "rough": """SELECT feature_id, part, ring, seq, x1, y1, CASE WHEN feature_id LIKE 't1%' AND seq = 3 THEN x2 + 1 ELSE x2 END AS x2, y2 FROM {zones} z
      UNION ALL SELECT 'bow' || CAST(k AS STRING), 1, 1, seq, x0 + a, y0 + b, x0 + c, y0 + d FROM {squares} q, (VALUES (1, 0, 0, 10, 10), (2, 10, 10, 10, 0), (3, 10, 0, 0, 10), (4, 0, 10, 0, 0)) AS e(seq, a, b, c, d)""",
    "flipped": "SELECT feature_id, part, ring, 10 - seq AS seq, x2 AS x1, y2 AS y1, x1 AS x2, y1 AS y2 FROM {zones} z",
    "lonlat": "SELECT c_custkey AS id, -87.0 + CAST(c_custkey % 61 AS DOUBLE) / 30 AS x, 40.0 + CAST(c_custkey % 59 AS DOUBLE) / 30 AS y FROM {customer}",
    "boxes": "SELECT c_custkey AS id, CAST(c_custkey % 170 AS DOUBLE) - 85.5 AS x_min, CAST(c_custkey % 80 AS DOUBLE) - 40.5 AS y_min, CAST(c_custkey % 170 AS DOUBLE) - 80.5 AS x_max, CAST(c_custkey % 80 AS DOUBLE) - 38.5 AS y_max FROM {customer}",
    "geojson": """SELECT concat('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"', CAST(k AS STRING), '"},"geometry":{"type":"Polygon","coordinates":[[[', CAST(CAST(x0 AS INT) AS STRING), ',', CAST(CAST(y0 AS INT) AS STRING), '],[', CAST(CAST(x0 AS INT) + 10 AS STRING), ',', CAST(CAST(y0 AS INT) AS STRING), '],[', CAST(CAST(x0 AS INT) AS STRING), ',', CAST(CAST(y0 AS INT) + 10 AS STRING), '],[', CAST(CAST(x0 AS INT) AS STRING), ',', CAST(CAST(y0 AS INT) AS STRING), ']]]}}]}') AS value FROM {squares} q""",
}
query("g1_geometry", "zones", f"""SELECT g.*, round(cx, 2) AS centroid_x, round(cy, 2) AS centroid_y, w AS bbox_width, h AS bbox_height FROM ({GEOM}) g JOIN (SELECT feature_id, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cy,
max(x1) - min(x1) AS w, max(y1) - min(y1) AS h FROM {{zones}} z GROUP BY 1) USING (feature_id)""")(op.geometry)  # fmt: skip
query("p7_filter_by_area", "zones", f"SELECT feature_id, area_ha FROM ({GEOM}) WHERE area_ha BETWEEN 0.0055 AND 0.02")(lambda z: op.filter_by_area(z, 0.0055, 0.02).select("feature_id", "area_ha"))
query("p7_area_excluded", "zones", f"SELECT count(*) AS n, min(area_ha) AS least, max(area_ha) AS most FROM ({GEOM}) WHERE NOT area_ha BETWEEN 0.0055 AND 0.02")(lambda z: op.area_excluded(z, 0.0055, 0.02))
_SIDE = "sign(({q}.x2 - {q}.x1) * ({p}.y{n} - {q}.y1) - ({q}.y2 - {q}.y1) * ({p}.x{n} - {q}.x1))"
_CROSS = " AND ".join(f"{_SIDE.format(p=p, q=q, n=1)} * {_SIDE.format(p=p, q=q, n=2)} < 0" for p, q in ("ab", "ba"))
query("g2_audit", "rough", f"""WITH e AS (SELECT * FROM {{rough}} r), s AS (SELECT *, lag(x2) OVER w <> x1 OR lag(y2) OVER w <> y1 AS gap FROM e WINDOW w AS (PARTITION BY feature_id, part, ring ORDER BY seq)),
 r AS (SELECT feature_id, part, ring, coalesce(bool_or(gap), false) AS gap, arg_min(x1, seq) <> arg_max(x2, seq) OR arg_min(y1, seq) <> arg_max(y2, seq) AS apart, count(DISTINCT (x1, y1)) AS different, count(*) AS n, sum(x1 * y2 - x2 * y1) AS area2 FROM s GROUP BY 1, 2, 3),
 f AS (SELECT feature_id, count(*) FILTER (gap OR apart) AS open_rings, count(*) FILTER (different < 3) AS thin_rings, count(*) FILTER (area2 = 0) AS empty_rings, count(*) FILTER (different < n) AS repeated FROM r GROUP BY 1),
 c AS (SELECT a.feature_id, count(*) AS crossings FROM e a JOIN e b ON a.feature_id = b.feature_id AND (a.part, a.ring, a.seq) < (b.part, b.ring, b.seq) AND {_CROSS} GROUP BY 1)
 SELECT f.*, coalesce(crossings, 0) AS crossings, open_rings + thin_rings + empty_rings + coalesce(crossings, 0) = 0 AS valid FROM f LEFT JOIN c USING (feature_id)""")(op.audit)  # fmt: skip
query("g2_audit_summary", "rough", "SELECT left(feature_id, 1) AS kind, count(*) AS n, count(*) FILTER (feature_id NOT LIKE 't1%' AND feature_id NOT LIKE 'bow%') AS valid FROM (SELECT DISTINCT feature_id FROM {rough} r) GROUP BY 1")(
    lambda r: op.audit(r).groupBy(F.substring("feature_id", 1, 1).alias("kind")).agg(F.count("*").alias("n"), F.count_if("valid").alias("valid")))
query("g3_normalise_rings", "flipped", "SELECT feature_id, sum(x1 * y2 - x2 * y1) / 2 AS area, count(*) AS n FROM {zones} z GROUP BY 1")(lambda e: op.normalise_rings(e).groupBy("feature_id").agg((F.sum(F.expr("x1 * y2 - x2 * y1")) / 2).alias("area"), F.count("*").alias("n")))
query("g4_reproject_mercator", "lonlat", "SELECT id, round(radians(x) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137, 3) AS y FROM {lonlat} p")(lambda p: op.reproject(p, 4326, 3857).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")))
for _code in (32616, 2263):
    query(f"g4_round_trip_{_code}", "lonlat", "SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM {lonlat} p")(lambda p, c=_code: op.reproject(op.reproject(p, 4326, c), c, 4326).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")))
query("g5_match_crs", "lonlat", "SELECT count(*) AS n, round(max(abs(radians(x) * 6378137)), 2) AS far FROM {lonlat} p")(lambda p: op.match_crs(op.reproject(p, 4326, 3857), p, 3857, 4326)[1].agg(F.count("*").alias("n"), F.round(F.max(F.abs("x")), 2).alias("far")))
query("s6_bbox", "zones", "SELECT feature_id, min(x1) AS x_min, min(y1) AS y_min, max(x1) AS x_max, max(y1) AS y_max FROM {zones} z GROUP BY 1")(lambda z: op.bbox(z, ["feature_id"]))
query("a30_spatial_overlap", "zones boundary", "SELECT true AS overlaps, round(100.0 * 100 / 3364, 2) AS overlap_pct")(op.bbox_overlap)
query("s7_tile_cover", "boxes", """SELECT id, CAST(y AS INT) AS lat, CAST(x AS INT) AS lon, format('{}{:02d}{}{:03d}', CASE WHEN y >= 0 THEN 'N' ELSE 'S' END, abs(y)::INT, CASE WHEN x >= 0 THEN 'E' ELSE 'W' END, abs(x)::INT) AS tile
FROM (SELECT id, x, unnest(range(floor(y_min / 3)::INT * 3, floor(y_max / 3)::INT * 3 + 1, 3)) AS y FROM (SELECT *, unnest(range(floor(x_min / 3)::INT * 3, floor(x_max / 3)::INT * 3 + 1, 3)) AS x FROM {boxes} b))""")(lambda b: op.tile_cover(b).select("id", "lat", "lon", "tile"))  # fmt: skip
query("s2_features_from_geojson", "geojson", "SELECT CAST(k AS STRING) AS feature_id, 3 AS n, 50.0 AS area FROM {squares} q")(
    lambda lines: op.edges_from_vertices(op.features_from_geojson(lines)).groupBy("feature_id").agg(F.count("*").cast("int").alias("n"), (F.sum(F.expr("x1 * y2 - x2 * y1")) / 2).alias("area")))
