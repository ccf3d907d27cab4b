"""Queries of the models. Trees have no SQL form; their rows are checked in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators import bagging, scores
from heatgrid.operators import models as op
from heatgrid.operators.cells import FEATURES, featurize_frames
from heatgrid.registry import query
from heatgrid.sources import standins

standins.SQL |= {
    "classify": "SELECT d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(length(d.lang) + ascii(d.lang) AS DOUBLE) AS lang_code, CAST(l.toxic AS DOUBLE) AS toxic, l.quality FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id",
    "labelled_pixels": "SELECT frame_id, row, col, CAST(p % 256 AS INT) AS r, CAST(frame_id % 256 AS INT) AS g, CAST(row % 256 AS INT) AS b, CASE WHEN row % 3 = 0 THEN CASE WHEN p % 256 > 128 THEN 1 ELSE 2 END ELSE 0 END AS label FROM (SELECT l_suppkey AS frame_id, CAST(l_orderkey AS INT) AS row, l_linenumber AS col, min(l_partkey) AS p FROM {lineitem} GROUP BY 1, 2, 3) t",
}
XS = ["n_chars", "lang_code", "toxic"]
for _kind in ("rf", "logistic", "gbt"):
    query(f"x11_classifier_{_kind}", "classify")(lambda df, k=_kind: op.apply_classifier(op.train_classifier(df, "quality", XS, k, 10), df).select("id", "pred", "confidence"))
query("x12_apply_classifier", "classify")(lambda df: scores.score_segmenters(op.apply_classifier(op.train_classifier(df, "quality", XS, "rf", 10, balanced=True), df).withColumns({"truth": F.col("quality") + 1, "pred": F.col("pred") + 1, "g": F.lit(1)}), ["g"]))
for _kind in ("rf", "gbt", "linear"):
    query(f"x13_regressor_{_kind}", "regress")(lambda df, k=_kind: scores.score_regression(op.apply_regressor(op.train_regressor(df, "y", ["x1", "x2"], k, 10), df), "y", "pred"))
query("x14_apply_regressor", "regress", "SELECT id, round(regr_slope(y, x1) OVER () * x1 + regr_intercept(y, x1) OVER (), 4) AS pred FROM {regress} t")(lambda df: op.apply_regressor(op.train_regressor(df, "y", ["x1"], "linear"), df).select("id", F.round("pred", 4).alias("pred")))
query("x13_importances", "regress")(lambda df: op.importances(op.train_regressor(df, "y", ["x1", "x2"], "rf", 10), df))
query("x16_cv_score", "classify")(lambda df: df.sparkSession.createDataFrame([(op.cv_score(df, "quality", XS, trees=5),)], "accuracy double"))
query("x16_oob_accuracy", "classify")(lambda df: bagging.oob_score(bagging.train_bag(df, "quality", XS, trees=8), df))
query("x16_oob_r2", "regress")(lambda df: bagging.oob_score(bagging.train_bag(df, "y", ["x1", "x2"], trees=8, regression=True), df))
query("x17_segment_pixels", "labelled_pixels")(lambda px: op.segment_pixels(featurize_frames(px.drop("label"), px.select("frame_id", "row", "col", "label")), FEATURES).groupBy("pred").agg(F.count("*").alias("n")))
