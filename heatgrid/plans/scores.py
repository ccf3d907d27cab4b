"""Queries of scores, profiles and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators import scores as op
from heatgrid.operators import vectors as vec
from heatgrid.plans.spatial import GEOM
from heatgrid.registry import query
from heatgrid.sources import standins

standins.SQL |= {
    "models": "SELECT frame, truth, a AS pred, 'first' AS model FROM {mask_pair} p UNION ALL SELECT frame, truth, b, 'second' FROM {mask_pair} q",
    "ranked": "SELECT c_custkey AS rank, 'm' || CAST(c_custkey AS STRING) AS model, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS s1, CAST(c_acctbal AS INT) AS s2 FROM {customer}",
    "sizes": "SELECT o_orderkey AS id, o_totalprice AS err FROM {orders}",
    "points_xy": "SELECT l_suppkey AS frame, l_quantity AS dx, l_tax AS dy FROM {lineitem}",
    "gaps": "SELECT row, col, CASE WHEN (row + col) % 4 = 0 THEN NULL ELSE value END AS value FROM {lst} t",
    "confident": "SELECT CAST(l_linenumber AS INT) AS pred, l_discount * 10 AS confidence FROM {lineitem}",
    "surveyed": "SELECT o_orderkey AS id, o_orderpriority AS status, o_totalprice / 500000 AS agreement FROM {orders}",
    "three": "SELECT CAST(l_partkey % 5 AS INT) AS raw, CAST((l_partkey + l_linenumber) % 5 AS INT) AS rect, CAST(l_linenumber % 5 AS INT) AS truth FROM {lineitem}",
}
standins.SPARK["ranked"] = standins.SQL["ranked"].replace("CAST(c_acctbal AS INT)", "CAST(rint(c_acctbal) AS INT)")
SEG = """WITH c AS (SELECT frame, model, truth AS t, pred AS p, count(*) AS n FROM {models} m WHERE truth <> 0 GROUP BY ALL), tot AS (SELECT frame, model, sum(n) AS n, sum(n) FILTER (t = p) AS hits FROM c GROUP BY ALL),
r AS (SELECT frame, model, t AS k, sum(n) AS tn, coalesce(sum(n) FILTER (t = p), 0) AS tp FROM c GROUP BY ALL), q AS (SELECT frame, model, p AS k, sum(n) AS pn FROM c GROUP BY ALL),
j AS (SELECT frame, model, k, coalesce(tn, 0) AS tn, coalesce(tp, 0) AS tp, coalesce(pn, 0) AS pn FROM r FULL JOIN q USING (frame, model, k)),
m AS (SELECT frame, model, sum(tn * pn)::DOUBLE AS x, avg(CASE WHEN tn > 0 THEN tp / (tn + pn - tp) END) AS miou FROM j GROUP BY ALL),
s AS (SELECT frame, model, n, coalesce(hits, 0) / n AS po, x / (n * n) AS pe, miou FROM tot JOIN m USING (frame, model))
"""
SCORES = SEG + "SELECT frame, model, n, round(po, 4) AS accuracy, round(miou, 4) AS mean_iou, round(CASE WHEN 1 - pe > 1e-12 THEN (po - pe) / (1 - pe) END, 4) AS kappa FROM s"
query("a13_score_segmenters", "models", SCORES)(lambda m: op.score_segmenters(m, ["frame", "model"]))
query("a13_class_scores", "models", SEG + "SELECT frame, model, k AS class, tn AS n, round(tp / tn, 4) AS recall, round(tp / (tn + pn - tp), 4) AS iou FROM j WHERE tn > 0")(lambda m: op.class_scores(m, ["frame", "model"]))
query("a14_winners", "ranked", "SELECT 's1' AS dimension, arg_max(model, s1 * 10000000 - rank) AS winner FROM {ranked} r UNION ALL SELECT 's2', arg_max(model, s2 * 10000000::BIGINT - rank) FROM {ranked} q")(lambda r: op.winners(r, "model", ["s1", "s2"]))
query("a14_macro_average", "models", f"SELECT model, round(avg(accuracy), 4) AS accuracy, round(avg(kappa), 4) AS kappa FROM ({SCORES}) GROUP BY model")(lambda m: op.macro_average(op.score_segmenters(m, ["frame", "model"]), ["model"], ["accuracy", "kappa"]))
query("a15_disagreement_rate", "mask_pair", "SELECT frame, count(*) AS n, round(avg((a = b)::INT), 4) AS agreement FROM {mask_pair} p WHERE a <> 0 AND b <> 0 GROUP BY frame")(lambda p: op.disagreement_rate(p, ["frame"]))
query("t2_contested_pairs", "mask_pair", "SELECT a, b, count(*) AS n FROM {mask_pair} p WHERE a <> 0 AND b <> 0 AND a <> b GROUP BY a, b ORDER BY n DESC, a, b LIMIT 8")(op.contested_pairs)
query("a15_agree_map", "mask_pair", "SELECT *, CASE WHEN a = b THEN 255 ELSE 0 END AS agree FROM {mask_pair} p WHERE a <> 0 AND b <> 0")(op.agree_map)
query("j7_pair_predictions", "pred_truth", "SELECT id, pred, truth FROM {pred_truth} p")(lambda p: op.pair_predictions(p.select("id", "pred"), p.select("id", "truth")).select("id", "pred", "truth"))
query("a16_score_regression", "pred_truth", "SELECT count(*) AS n, round(1 - sum((truth - pred) ** 2) / (var_pop(truth) * count(*)), 4) AS r2, round(sqrt(avg((truth - pred) ** 2)), 4) AS rmse, round(avg(abs(truth - pred)), 4) AS mae FROM {pred_truth} p")(op.score_regression)
_L1 = lambda c: " + ".join(f"abs(count(*) FILTER ({c} = {k}) / count(*) FILTER ({c} <> 0) - count(*) FILTER (truth = {k}) / count(*) FILTER (truth <> 0))" for k in (1, 2, 3, 4))
query("a17_composition_error", "three", f"SELECT *, CASE WHEN improvement > 0 THEN 'supported' ELSE 'kill_switch' END AS verdict FROM (SELECT *, round(raw_error - rect_error, 4) AS improvement FROM (SELECT round({_L1('raw')}, 4) AS raw_error, round({_L1('rect')}, 4) AS rect_error FROM {{three}} t))")(lambda t: op.composition_error(t, 0.9, [1, 2, 3, 4]))
query("a26_confidence_by_class", "confident", "SELECT pred, round(avg(confidence), 3) AS confidence, round(avg(confidence), 3) < 0.6 AS warn FROM {confident} c GROUP BY pred")(op.confidence_by_class)
query("a27_class_counts", "mask_pair", "SELECT truth, count(*) AS n, count(*) < 30 AS warn FROM {mask_pair} p GROUP BY truth")(lambda p: op.class_counts(p, "truth"))
query("a28_drop_outliers_mad", "sizes", "SELECT id, err FROM {sizes} s WHERE err <= (SELECT median(err) + greatest(mad(err), 1e-9) * 1.5 FROM {sizes} t)")(lambda s: op.drop_outliers_mad(s, "err", 1.5))
query("a29_frame_rms", "points_xy", "SELECT frame, round(sqrt(avg(dx * dx + dy * dy)), 4) AS rms FROM {points_xy} p GROUP BY frame")(op.frame_rms)
query("w7_rank_frames", "points_xy", "SELECT frame, rms, rank() OVER (ORDER BY rms DESC) AS rank FROM (SELECT frame, round(sqrt(avg(dx * dx + dy * dy)), 4) AS rms FROM {points_xy} p GROUP BY frame)")(lambda p: op.rank_frames(op.frame_rms(p)))
query("a21_raster_profile", "gaps", "SELECT max(row) - min(row) + 1 AS n_rows, max(col) - min(col) + 1 AS n_cols, round(100 * (count(*) - count(value)) / count(*), 2) AS nodata_pct, min(value) AS least, max(value) AS most, 1.0 AS resolution FROM {gaps} g")(op.raster_profile)
query("a22_vector_profile", "zones", f"SELECT count(*) AS n_features, round(sum(area_m2), 2) AS total_area_m2 FROM ({GEOM})")(lambda z: op.vector_profile(vec.geometry(z)))
query("a23_table_profile", "gaps", "SELECT count(*) AS n_rows, 3 AS n_columns, count(value) AS complete, round(100 * (count(*) - count(value)) / (count(*) * 3), 2) AS missing_pct FROM {gaps} g")(op.table_profile)
query("a24_validate_raster", "gaps", "SELECT 'warning' AS level, 'validate_raster' AS step, unnest(list_filter([CASE WHEN 100 * (count(*) - count(value)) / count(*) > 20 THEN 'too many cells without data' END, CASE WHEN min(value) < 20 THEN 'values below the expected range' END, CASE WHEN max(value) > 30 THEN 'values above the expected range' END], lambda x: x IS NOT NULL)) AS message FROM {gaps} g")(
    lambda g: op.validate_raster(g, 20, 30))
query("a25_validate_vector", "rough", "SELECT 'warning' AS level, 'invalid features' AS message, count(DISTINCT feature_id) AS n FROM {rough} r WHERE feature_id LIKE 't1%' OR feature_id LIKE 'bow%' UNION ALL SELECT 'warning', 'features without area', 25 FROM (SELECT 1)")(lambda r: op.validate_vector(vec.audit(r)))
query("a31_check_alignment", "zones boundary", "SELECT true AS same_crs, false AS overlap_ok, 1.0 AS resolved")(lambda z, b: op.check_alignment(vec.bbox_overlap(z, b), vec.geometry(z), True, 1.0))
query("a32_validate_boundaries", "rough", "SELECT DISTINCT feature_id FROM {rough} r WHERE feature_id NOT LIKE 't%' AND feature_id NOT LIKE 'bow%'")(lambda r: op.validate_boundaries(vec.audit(r), vec.geometry(r), 0.0051).select("feature_id"))
query("a33_survey_status", "surveyed", "SELECT status, count(*) AS n, round(avg(agreement), 4) AS agreement FROM {surveyed} s GROUP BY status")(op.survey_status)
query("j9_attach_partition", "samples", "SELECT id, stratum, CASE WHEN id % 3 = 0 THEN 'test' ELSE 'train' END AS part FROM {samples} s")(lambda s: s.select("id", "stratum").join(s.select("id", F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("part")), "id"))
query("u1_pool", "mask_pair", "SELECT frame, a AS code FROM {mask_pair} p UNION ALL SELECT frame, b FROM {mask_pair} q")(lambda p: p.select("frame", F.col("a").alias("code")).unionByName(p.select("frame", F.col("b").alias("code"))))
query("u4_set_difference", "lc crosswalk", "SELECT DISTINCT code FROM {lc} c EXCEPT SELECT code FROM {crosswalk} m")(lambda lc, m: lc.select("code").subtract(m.select("code")))
query("u4_set_intersection", "lc crosswalk", "SELECT code FROM {lc} c INTERSECT SELECT code FROM {crosswalk} m")(lambda lc, m: lc.select("code").intersect(m.select("code")))
query("j10_lookup_class", "lc crosswalk", "SELECT c.row, c.col, target FROM {lc} c JOIN {crosswalk} m ON m.code = c.code")(lambda lc, m: lc.join(F.broadcast(m), "code").select("row", "col", "target"))
