"""Queries of the cell operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators import cells as op
from heatgrid.registry import query

query("p1_scale_cells", "lst", "SELECT row, col, round(value * 0.5 + 10, 4) AS value FROM {lst} t")(lambda lst: op.scale_cells(lst, 0.5, 10.0).withColumn("value", F.round("value", 4)))
query("p1_range_warnings", "lst", "SELECT 'warning' AS level, 'scale_cells' AS step, 'values outside the plausible range' AS message, count(*) AS n FROM {lst} t WHERE value * 4 > 80 OR value * 4 < -60 HAVING count(*) > 0")(lambda lst: op.range_warnings(op.scale_cells(lst, 4.0)))
_QA = "SELECT CAST(l_partkey % 64 AS INT) AS row, CAST(l_orderkey % 64 AS INT) AS col, CAST(max(l_linenumber) * 32 + min(l_suppkey) % 3 AS INT) AS qa FROM {lineitem} GROUP BY 1, 2"
_BANDS = "SELECT CAST(l_partkey % 64 AS INT) AS row, CAST(l_orderkey % 64 AS INT) AS col, CAST(9000 + min(l_suppkey) % 7 * 800 AS INT) AS nir, CAST(CASE WHEN min(l_partkey) % 9 = 0 THEN 0 ELSE 7000 + min(l_partkey) % 7 * 500 END AS INT) AS red, CAST(min(l_linenumber) % 3 AS INT) * 32 + CAST(min(l_suppkey) % 4 = 1 AS INT) AS qa FROM {lineitem} GROUP BY 1, 2"


def _register_sources() -> None:
    from heatgrid.sources import standins

    standins.SQL |= {
        "qa": _QA, "bands": _BANDS,
        "arr": "SELECT vec_id, embedding, label FROM {embeddings}",
        "dims": "SELECT CAST(l_partkey % 64 AS INT) AS row, CAST(l_orderkey % 64 AS INT) AS col, l_quantity AS value, CAST(l_linenumber AS INT) AS time, l_orderkey AS k FROM {lineitem}",
        "stack": "SELECT row, col, time, sum(value) AS value FROM {dims} d GROUP BY 1, 2, 3",
        "names": "SELECT p_partkey AS index, p_name || ';' || p_type || ', ' || p_brand AS name FROM {part}",
        "tokens": "SELECT lower(p_brand) AS token, CAST(max(p_size) AS INT) AS code FROM {part} WHERE p_partkey % 3 > 0 GROUP BY 1",
        "grid": "SELECT CAST(l_partkey % 16 AS INT) AS row, CAST(l_orderkey % 16 AS INT) AS col, sum(l_quantity) AS value FROM {lineitem} GROUP BY 1, 2",
        "paths": "SELECT page_id, CAST(page_id AS STRING) || CASE page_id % 5 WHEN 0 THEN '.GeoJSON' WHEN 1 THEN '.tif' WHEN 2 THEN '.YML' WHEN 3 THEN '.TIFF' ELSE '.txt' END AS path, CASE WHEN page_id % 3 = 0 THEN 'plain' ELSE 'p_s' || CAST(page_id % 4 AS STRING) || '_x' END AS name FROM {pages}",
    }


_register_sources()
query("p2_dn_to_celsius", "lst qa", "SELECT t.row, t.col, CASE WHEN (q.qa & 31) = 0 AND value <> 0 THEN round(value * 1000 * 0.00341802::DOUBLE + 149.0::DOUBLE - 273.15::DOUBLE, 3) END AS value FROM {lst} t LEFT JOIN {qa} q ON q.row = t.row AND q.col = t.col")(
    lambda lst, qa: op.dn_to_celsius(op.scale_cells(lst, 1000.0), qa).withColumn("value", F.round("value", 3)))
query("p3_qa_bad", "qa", "SELECT row, col, (qa & 31) > 0 AS bad FROM {qa} t")(lambda qa: qa.select("row", "col", op.qa_bad(F.col("qa")).alias("bad")))
query("p4_ndvi", "bands", """SELECT row, col, round(CASE WHEN nir <> 0 AND red <> 0 AND (qa & 31) = 0 AND abs(v) <= 1 THEN v END, 4) AS value FROM (
  SELECT *, ((nir * 0.0000275 - 0.2) - (red * 0.0000275 - 0.2))::DOUBLE / nullif((nir * 0.0000275 - 0.2) + (red * 0.0000275 - 0.2), 0)::DOUBLE AS v FROM {bands} t)""")(lambda bands: op.ndvi(bands).withColumn("value", F.round("value", 4)))  # fmt: skip
query("p5_valid_mask", "lst lc", "SELECT t.row, t.col, value, code FROM {lst} t JOIN {lc} c ON c.row = t.row AND c.col = t.col WHERE value <> 0 AND code <> 0")(lambda lst, lc: op.valid_mask(lst, lc))
query("p5_valid_fraction", "lst lc", "SELECT count(*) AS n, count(*) FILTER (value <> 0 AND code <> 0) AS n_valid, count(*) FILTER (value <> 0 AND code <> 0) / count(*) AS fraction FROM {lst} t LEFT JOIN {lc} c ON c.row = t.row AND c.col = t.col")(op.valid_fraction)
query("p6_mask_by_class", "lst lc", "SELECT t.row, t.col, CASE WHEN coalesce(code IN (80, 50), false) THEN NULL ELSE value END AS value FROM {lst} t LEFT JOIN {lc} c ON c.row = t.row AND c.col = t.col")(lambda lst, lc: op.mask_by_class(lst, lc, [80, 50]))
query("p6_mask_report", "lst lc", "SELECT n_masked, round(100 * n_masked / n, 4) AS pct_masked, round(100 * n_masked / n, 4) > 30 AS warn FROM (SELECT count(*) FILTER (coalesce(code IN (80, 50), false)) AS n_masked, count(*) AS n FROM {lst} t LEFT JOIN {lc} c ON c.row = t.row AND c.col = t.col)")(
    lambda lst, lc: op.mask_report(lst, op.mask_by_class(lst, lc, [80, 50])))
query("p10_clip_to_bbox", "lst", "SELECT * FROM {lst} t WHERE col BETWEEN 10 AND 40 AND row BETWEEN 5 AND 20")(lambda lst: op.clip_to_bbox(lst, 10, 5, 40, 20))
query("p11_complete_cases", "regress", "SELECT * FROM {regress} t WHERE y IS NOT NULL AND x3 IS NOT NULL")(lambda df: op.complete_cases(df, ["y", "x3"]))
query("p11_dropped_cases", "regress", "SELECT count(*) AS n, count(*) FILTER (y IS NULL OR x3 IS NULL) AS dropped, count(*) - count(*) FILTER (y IS NULL OR x3 IS NULL) < 10 AS error FROM {regress} t")(lambda df: op.dropped_cases(df, ["y", "x3"]))
query("p12_log_shift", "regress", "SELECT id, round(ln(y), 6) AS y, round(ln(x1), 6) AS x1, round(CASE WHEN m > 0 THEN ln(x2) ELSE ln(x2 + abs(m) + 1) END, 6) AS x2 FROM {regress} t, (SELECT min(x2) AS m FROM {regress} u)")(
    lambda df: op.log_shift(df.select("id", "y", "x1", "x2"), ["y", "x1", "x2"]).select("id", *[F.round(c, 6).alias(c) for c in ("y", "x1", "x2")]))
query("p13_apply_crosswalk", "lc crosswalk", "SELECT c.*, target FROM {lc} c LEFT JOIN {crosswalk} m ON m.code = c.code")(op.apply_crosswalk)
query("j12_unmapped", "lc crosswalk", "SELECT code, count(*) AS n FROM {lc} c WHERE code NOT IN (SELECT code FROM {crosswalk} m) GROUP BY code")(op.unmapped)
query("p14_snap_palette", "pixels palette", """SELECT p.*, code FROM {pixels} p JOIN (
  SELECT r, g, b, CASE WHEN min(d2) <= 900 THEN arg_min(code, d2 * 10 + code) ELSE 0 END AS code FROM (SELECT r, g, b, code, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS d2 FROM (SELECT DISTINCT r, g, b FROM {pixels} q), {palette} a) GROUP BY r, g, b
) s USING (r, g, b)""")(op.snap_palette)  # fmt: skip
query("p15_drop_small_classes", "lc", "SELECT row, col, CASE WHEN count(*) OVER (PARTITION BY code) >= 900 THEN code ELSE 0 END AS code FROM {lc} t")(lambda lc: op.drop_small_classes(lc, 900))
query("p16_label_lut", "names tokens", """SELECT n.index, coalesce(c, 0) AS code FROM {names} n LEFT JOIN (
  SELECT index, arg_min(code, pos) AS c FROM (SELECT index, lower(trim(unnest(regexp_split_to_array(name, '[;,]')))) AS token, generate_subscripts(regexp_split_to_array(name, '[;,]'), 1) AS pos FROM {names} m) JOIN {tokens} k USING (token) GROUP BY index
) h ON h.index = n.index""")(op.label_lut)  # fmt: skip
query("p17_visible_indices", "pixels", """SELECT frame_id, ord, line, 2 * g - r - b AS exg, round(greatest(-1.0, least(1.0, (g - r) / (g + r - b + 1e-6::DOUBLE))), 4) AS vari, round((2 * g - r - b) / (2 * g + r + b + 1e-6::DOUBLE), 4) AS gli, round((r + g + b) / 3, 4) AS grey FROM {pixels} t""")(
    lambda px: op.visible_indices(px).select("frame_id", "ord", "line", "exg", *[F.round(c, 4).alias(c) for c in ("vari", "gli", "grey")]))
query("p20_nodata_to_null", "lc", "SELECT row, col, CASE WHEN code IN (0, 255) THEN NULL ELSE code END AS code FROM {lc} t")(lambda lc: lc.withColumn("code", op.nodata_to_null(F.col("code"))))
query("p21_file_type", "paths", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'geojson' WHEN 1 THEN 'geotiff' WHEN 2 THEN 'manifest' WHEN 3 THEN 'geotiff' ELSE 'unknown' END AS file_type FROM {paths} t")(lambda p: p.select("page_id", op.file_type(F.col("path")).alias("file_type")))
query("p22_scene_of", "paths", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE 's' || (page_id % 4) END AS scene FROM {paths} t")(lambda p: p.select("page_id", op.scene_of(F.col("name")).alias("scene")))
query("s1_cells_from_arrays", "arr", "SELECT row, CAST(col AS INT) AS col, value FROM (SELECT vec_id AS row, generate_subscripts(embedding, 1) - 1 AS col, unnest(embedding) AS value FROM {arr} t) WHERE value IS NOT NULL")(lambda a: op.cells_from_arrays(a, "vec_id", "embedding"))
query("s8_mosaic", "stack", "SELECT row, col, arg_min(value, time) AS value FROM {stack} t GROUP BY row, col")(lambda s: op.mosaic(s, "time"))
for _how, _sql in (("median", "median(value)"), ("first", "arg_min(value, time)"), ("mosaic", "arg_max(value, time)")):
    query(f"s9_composite_{_how}", "stack", f"SELECT row, col, {_sql} AS value FROM {{stack}} t GROUP BY row, col")(lambda s, how=_how: op.composite(s, how))
query("j6_align", "lst lc", "SELECT t.row, t.col, value, code FROM {lst} t JOIN {lc} c ON c.row = t.row AND c.col = t.col")(op.align)
query("r2_resample_majority", "lc", "SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, arg_min(code, code - 1000 * n) AS code FROM (SELECT row // 4 AS row, col // 4 AS col, code, count(*) AS n FROM {lc} t GROUP BY ALL) GROUP BY row, col")(lambda lc: op.resample_majority(lc, 4))
query("r3_match_grid", "lc", "SELECT CAST(y AS INT) AS row, CAST(x AS INT) AS col, code FROM range(100) a(y), range(48) b(x) JOIN {lc} t ON t.row = floor((y + 0.5) * 64 / 100) AND t.col = floor((x + 0.5) * 64 / 48)")(lambda lc: op.match_grid(lc, 64, 64, 100, 48))
query("r4_resample_near", "lc", "SELECT CAST(y AS INT) AS row, CAST(x AS INT) AS col, code FROM range(128) a(y), range(128) b(x) JOIN {lc} t ON t.row = floor((y + 0.5) / 2) AND t.col = floor((x + 0.5) / 2)")(lambda lc: op.match_grid(lc, 64, 64, 128, 128))
query("w6_focal_std", "grid", """SELECT CAST(y AS INT) AS row, CAST(x AS INT) AS col, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0)), 4) AS texture
FROM range(16) a(y), range(16) b(x), range(-3, 4) c(dy), range(-3, 4) d(dx)
JOIN {grid} g ON g.row = CASE WHEN y + dy < 0 THEN -1 - y - dy WHEN y + dy > 15 THEN 31 - y - dy ELSE y + dy END AND g.col = CASE WHEN x + dx < 0 THEN -1 - x - dx WHEN x + dx > 15 THEN 31 - x - dx ELSE x + dx END GROUP BY y, x""")(
    lambda g: op.focal_std(g).withColumn("texture", F.round("texture", 4)))
