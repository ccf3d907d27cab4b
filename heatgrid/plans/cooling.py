"""Queries of the cooling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators import cooling as op
from heatgrid.registry import query
from heatgrid.sources import standins

standins.SQL |= {
    "lst_lc": "SELECT t.row, t.col, value, code FROM {lst} t JOIN {lc} c ON c.row = t.row AND c.col = t.col WHERE code <> 0",
    "masks": "SELECT l_suppkey AS space, CAST(l_partkey % 8 AS INT) AS code FROM {lineitem}",
    "weights": "SELECT * FROM (VALUES (1, 1.0E0), (2, 0.8E0), (3, 0.5E0), (4, 0.1E0), (5, -0.5E0), (6, 0.9E0)) AS t(code, weight)",
    "coarse_composition": "SELECT space, cls, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY space) AS DOUBLE) AS fraction FROM (SELECT c_nationkey % 3 AS space, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'canopy' WHEN 'BUILDING' THEN 'grass' WHEN 'FURNITURE' THEN 'impervious' WHEN 'HOUSEHOLD' THEN 'water' ELSE 'soil' END AS cls, count(*) AS n FROM {customer} GROUP BY 1, 2) t",
    "readings": "SELECT c_nationkey AS scene, c_mktsegment AS model, c_acctbal AS green FROM {customer}",
}
PCI = """WITH r AS (SELECT *, row_number() OVER w AS j, lead(lst_median) OVER w AS nxt FROM {rings} q WINDOW w AS (PARTITION BY feature_id ORDER BY distance_m)),
t AS (SELECT *, min(CASE WHEN lst_median > nxt AND j >= 3 THEN j END) OVER (PARTITION BY feature_id) AS turn FROM r),
p AS (SELECT feature_id, count(lst_median) AS n_rings, min(turn) AS turn, max(CASE WHEN j = turn THEN lst_median END) AS tv, max(CASE WHEN j = turn THEN distance_m END) AS td, avg(CASE WHEN j <= turn THEN lst_median END) AS tm,
  arg_max(lst_median, j) AS ov, arg_max(distance_m, j) AS od FROM t GROUP BY 1),
s AS (SELECT p.*, i.lst_median AS park, CASE WHEN n_rings < 3 THEN 'insufficient_rings' WHEN i.lst_median IS NULL THEN 'no_interior_lst' WHEN turn IS NULL THEN 'no_turning_point_found' ELSE 'success' END AS status FROM p LEFT JOIN {interior} i USING (feature_id)),
pci AS (SELECT feature_id, round(CASE status WHEN 'success' THEN LEVEL WHEN 'no_turning_point_found' THEN ov END - park, 4) AS PCI, CASE status WHEN 'success' THEN td WHEN 'no_turning_point_found' THEN od END AS turning_point_m, round(park, 4) AS lst_park,
  round(CASE status WHEN 'success' THEN tv WHEN 'no_turning_point_found' THEN ov END, 4) AS lst_turning_point, n_rings, status FROM s)
"""
query("w1_park_cooling_intensity", "rings interior", PCI.replace("LEVEL", "tv") + "SELECT * FROM pci")(lambda r, i: op.park_cooling_intensity(r, i, min_rings=3))
query("w1_park_cooling_mean", "rings interior", PCI.replace("LEVEL", "tm") + "SELECT * FROM pci")(lambda r, i: op.park_cooling_intensity(r, i, "TPM-A", 3))
query("a20_pci_quality", "rings interior", PCI.replace("LEVEL", "tv") + """SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'no_turning_point_found') AS no_turning_point_found, count(*) FILTER (status = 'insufficient_rings') AS insufficient_rings,
count(*) FILTER (status = 'no_interior_lst') AS no_interior_lst, count(*) FILTER (PCI < 0) AS n_negative, round(100 * count(*) FILTER (PCI < 0) / count(PCI), 2) AS pct_negative, min(PCI) AS least, max(PCI) AS most, round(avg(PCI), 4) AS mean, round(median(PCI), 4) AS median FROM pci""")(
    lambda r, i: op.pci_quality(op.park_cooling_intensity(r, i, min_rings=3)))
query("j8_pci_inputs", "rings interior", "SELECT r.*, i.lst_median AS park FROM {rings} r LEFT JOIN {interior} i USING (feature_id)")(lambda r, i: r.join(i.dropDuplicates(["feature_id"]).withColumnRenamed("lst_median", "park"), "feature_id", "left"))
query("a5_class_statistics", "lst_lc", "SELECT code, count(*) AS n, round(avg(value), 3) AS mean, round(median(value), 3) AS median, round(stddev_pop(value), 3) AS std FROM {lst_lc} t GROUP BY code")(op.class_statistics)
DIFFERENTIAL = """SELECT *, diff_median AS differential, least(forest_n, open_n) < 20 AS few_pixels FROM (SELECT fn AS forest_n, o_n AS open_n, round(fm, 3) AS forest_mean, round(fd, 3) AS forest_median, round(fs, 3) AS forest_std, round(om, 3) AS open_mean, round(od, 3) AS open_median, round(os, 3) AS open_std, round(om - fm, 3) AS diff_mean, round(od - fd, 3) AS diff_median
FROM (SELECT count(*) FILTER (code = 10) AS fn, avg(value) FILTER (code = 10) AS fm, median(value) FILTER (code = 10) AS fd, stddev_pop(value) FILTER (code = 10) AS fs, count(*) FILTER (code IN (30, 50)) AS o_n, avg(value) FILTER (code IN (30, 50)) AS om, median(value) FILTER (code IN (30, 50)) AS od, stddev_pop(value) FILTER (code IN (30, 50)) AS os FROM {lst_lc} t))"""
query("a5_cooling_differential", "lst_lc", DIFFERENTIAL)(
    lambda c: op.cooling_differential(c, [10], [30, 50]))
query("a6_class_distribution", "lc", "SELECT code, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM {lc} t WHERE code > 0 GROUP BY code")(op.class_distribution)
query("a7_space_cooling_potential", "masks weights", """SELECT space, round(sum(weight * f), 4) AS index, round(coalesce(sum(f) FILTER (code IN (1, 2, 3)), 0), 5) AS green, round(coalesce(sum(f) FILTER (code = 6), 0), 5) AS blue, arg_max(code, f * 100000 * 10 - code) AS dominant
FROM (SELECT space, code, round(count(*) / sum(count(*)) OVER (PARTITION BY space), 5) AS f FROM {masks} m WHERE code <> 0 GROUP BY space, code) JOIN {weights} w USING (code) GROUP BY space""")(lambda m, w: op.space_cooling_potential(m, w, {"green": [1, 2, 3], "blue": [6]}))  # fmt: skip
_W = {"canopy": 1.0, "grass": 0.5, "impervious": -0.5, "water": 0.8, "soil": 0.1}
_WSQL = "CASE cls " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _W.items()) + " END"
query("a8_counterfactual_cooling", "coarse_composition", f"""SELECT space, round(sum(f * w), 4) AS index_before, round(sum(f2 * w), 4) AS index_after, round(round(sum(f2 * w), 4) - round(sum(f * w), 4), 4) AS delta FROM (
SELECT space, cls, f, {_WSQL} AS w, CASE cls WHEN 'impervious' THEN round(f - round(f * 0.25, 5), 5) WHEN 'grass' THEN round(round(f + p1, 5) - p2, 5) WHEN 'canopy' THEN round(f + p2, 5) ELSE f END AS f2
FROM (SELECT *, round((gf + p1) * 0.5, 5) AS p2 FROM (SELECT *, round(max(CASE WHEN cls = 'impervious' THEN f END) OVER (PARTITION BY space) * 0.25, 5) AS p1, max(CASE WHEN cls = 'grass' THEN f END) OVER (PARTITION BY space) AS gf FROM (SELECT space, cls, round(fraction, 5) AS f FROM {{coarse_composition}} c)))) GROUP BY space""")(
    lambda c: op.counterfactual_cooling(c, _W, [("impervious", "grass", 0.25), ("grass", "canopy", 0.5), ("absent", "canopy", 1.0), ("soil", "no_such", 1.0)]))
for _mode, _cls, _where in (("measured", "cls", "true"), ("excluded", "cls", "cls <> 'soil'"), ("organic", "CASE cls WHEN 'soil' THEN 'grass' ELSE cls END", "true")):
    query(f"a9_predicted_lst_{_mode}", "composition class_lst", f"SELECT space, round(CASE WHEN NOT bool_or(lst IS NULL) THEN sum(fraction * lst::DOUBLE) / sum(fraction) END, 3) AS lst FROM (SELECT space, fraction, {_cls} AS cls FROM {{composition}} c WHERE cls <> 'water' AND {_where}) c LEFT JOIN {{class_lst}} t ON t.cls = c.cls GROUP BY space")(
        lambda c, t, m=_mode: op.predicted_lst(c.where("cls <> 'water'"), t.withColumn("lst", F.col("lst").cast("double")), m))
query("a9_predicted_lst_missing", "composition class_lst", "SELECT space, round(CASE WHEN NOT bool_or(lst IS NULL) THEN sum(fraction * lst::DOUBLE) / sum(fraction) END, 3) AS lst FROM {composition} c LEFT JOIN {class_lst} t ON t.cls = c.cls GROUP BY space")(lambda c, t: op.predicted_lst(c, t.withColumn("lst", F.col("lst").cast("double"))))
query("a10_scene_rollup", "readings", "SELECT scene, model, round(avg(green), 3) AS mean, count(green) AS n FROM {readings} r GROUP BY scene, model")(lambda r: op.scene_rollup(r, ["scene", "model"], "green"))
query("a11_green_pivot", "readings", "SELECT scene, round(avg(green) FILTER (model = 'BUILDING'), 3) AS \"BUILDING\", round(avg(green) FILTER (model = 'MACHINERY'), 3) AS \"MACHINERY\" FROM {readings} r GROUP BY scene")(lambda r: op.green_pivot(r, "scene", "model", ["BUILDING", "MACHINERY"], "green"))
query("a12_satellite_fraction", "lc", "SELECT round(count(*) FILTER (code IN (10, 30)) / count(*), 5) AS fraction FROM {lc} t")(lambda lc: op.satellite_fraction(lc, [10, 30]))
