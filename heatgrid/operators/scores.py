"""Scores of predictions and masks, quality profiles and validators. Sums meet as small confusion or count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.operators.checks import require_columns
from heatgrid.functions.order import medians, rank_descending


def confusion(pairs: DataFrame, by: list[str], truth: str, pred: str, nodata: int = 0) -> DataFrame:
    return pairs.where(F.col(truth) != nodata).groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def score_segmenters(pairs: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred", nodata: int = 0) -> DataFrame:
    """Accuracy, mean IoU over the true classes and Cohen's kappa (null where chance agreement is 1) of each group."""
    c = confusion(pairs, by, truth, pred, nodata)
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("tn"), hit.alias("tp"), F.lit(0).cast("bigint").alias("pn")), F.struct(F.col("p").alias("k"), F.lit(0).cast("bigint").alias("tn"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("pn")))
    marginal = c.dropna(subset=by).select(*by, F.explode(sides).alias("s")).groupBy(*by, "s.k").agg(*[F.sum(f"s.{x}").alias(x) for x in ("tn", "tp", "pn")])  # the pairs are read once
    out = marginal.groupBy(*by).agg(F.sum("tn").alias("n"), F.sum("tp").alias("hits"), F.sum(F.col("tn").cast("double") * F.col("pn")).alias("cross"), F.avg(F.when(F.col("tn") > 0, F.col("tp") / (F.col("tn") + F.col("pn") - F.col("tp")))).alias("miou"))
    po, pe = F.col("hits") / F.col("n"), F.col("cross") / (F.col("n").cast("double") * F.col("n"))
    return out.select(*by, "n", F.round(po, 4).alias("accuracy"), F.round("miou", 4).alias("mean_iou"), F.round(F.when(1 - pe > 1e-12, (po - pe) / (1 - pe)), 4).alias("kappa"))


def class_scores(pairs: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred", nodata: int = 0) -> DataFrame:
    """Recall and IoU of each true class."""
    c = confusion(pairs, by, truth, pred, nodata)
    rows = c.groupBy(*by, F.col("t").alias("class")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    cols = c.groupBy(*by, F.col("p").alias("class")).agg(F.sum("n").alias("pn"))
    out = rows.join(cols, [*by, "class"], "left")
    return out.select(*by, "class", "n", F.round(F.col("tp") / F.col("n"), 4).alias("recall"), F.round(F.col("tp") / (F.col("n") + F.coalesce("pn", F.lit(0)) - F.col("tp")), 4).alias("iou"))


def winners(scores: DataFrame, model: str, dimensions: list[str]) -> DataFrame:
    """(dimension, winner): the best model, the first of ties."""
    best = scores.agg(*[F.max_by(model, F.when(F.col(d).isNotNull(), F.struct(d, -F.col("rank")))).alias(d) for d in dimensions])
    return best.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("winner")) for d in dimensions])).alias("r")).select("r.*")


def macro_average(scores: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(*[F.round(F.avg(v), 4).alias(v) for v in values])


def disagreement_rate(pairs: DataFrame, by: list[str], nodata: int = 0) -> DataFrame:
    both = pairs.where((F.col("a") != nodata) & (F.col("b") != nodata))
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 4).alias("agreement"))


def contested_pairs(pairs: DataFrame, nodata: int = 0, top: int = 8) -> DataFrame:
    """The most frequent pairs of different classes, ties by class."""
    both = pairs.where((F.col("a") != nodata) & (F.col("b") != nodata) & (F.col("a") != F.col("b")))
    return both.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(top)


def agree_map(pairs: DataFrame, nodata: int = 0) -> DataFrame:
    return pairs.where((F.col("a") != nodata) & (F.col("b") != nodata)).withColumn("agree", F.when(F.col("a") == F.col("b"), 255).otherwise(0))


def pair_predictions(pred: DataFrame, truth: DataFrame, id_col: str = "id") -> DataFrame:
    return require_columns(pred, id_col).join(require_columns(truth, id_col), id_col)


def score_regression(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """n, R2 (1 - residual over total squares), RMSE and MAE; nulls below two rows."""
    t, e = F.col(truth), F.col(truth) - F.col(pred)
    one = pairs.where(t.isNotNull() & F.col(pred).isNotNull()).agg(F.count("*").alias("n"), F.sum(e * e).alias("res"), (F.var_pop(t) * F.count("*")).alias("tot"), F.avg(F.abs(e)).alias("mae"))
    ok = F.col("n") >= 2
    return one.select("n", F.round(F.when(ok & (F.col("tot") > 0), 1 - F.col("res") / F.col("tot")), 4).alias("r2"), F.round(F.when(ok, F.sqrt(F.col("res") / F.col("n"))), 4).alias("rmse"), F.round(F.when(ok, F.col("mae")), 4).alias("mae"))


def composition_error(masks: DataFrame, coverage: float, classes: list[int]) -> DataFrame:
    """L1 distance of raw and rectified class shares to the truth, from cells (raw, rect, truth); 0 is nodata."""
    share = lambda c, k: F.count_if(F.col(c) == k) / F.count_if(F.col(c) != 0)
    l1 = lambda c: sum(F.abs(share(c, k) - share("truth", k)) for k in classes)
    out = masks.agg(F.round(l1("raw"), 4).alias("raw_error"), F.round(l1("rect"), 4).alias("rect_error")).withColumn("improvement", F.round(F.col("raw_error") - F.col("rect_error"), 4))
    return out.withColumn("verdict", F.when(F.lit(coverage) < 0.5, "inconclusive").when(F.col("improvement") > 0, "supported").otherwise("kill_switch"))


def confidence_by_class(pred: DataFrame, least: float = 0.6) -> DataFrame:
    return pred.groupBy("pred").agg(F.round(F.avg("confidence"), 3).alias("confidence")).withColumn("warn", F.col("confidence") < least)


def class_counts(df: DataFrame, label: str, least: int = 30) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).withColumn("warn", F.col("n") < least)


def drop_outliers_mad(df: DataFrame, value: str, k: float = 3.0, min_keep: int = 10) -> DataFrame:
    """Rows up to median + k MAD (at least 1e-9), or all if that leaves fewer than ``min_keep``. Two one-row sums."""
    mid = medians(df, value, []).withColumnRenamed("median", "_m")
    away = medians(df.crossJoin(F.broadcast(mid)).select(F.abs(F.col(value) - F.col("_m")).alias("_away")), "_away", []).withColumnRenamed("median", "_d")
    cut = mid.crossJoin(away).select((F.col("_m") + k * F.greatest("_d", F.lit(1e-9))).alias("_cut"))  # one row each
    n = df.crossJoin(F.broadcast(cut)).agg(F.first("_cut").alias("_cut"), F.count_if(F.col(value) <= F.col("_cut")).alias("_n"))
    return df.crossJoin(F.broadcast(n)).where((F.col(value) <= F.col("_cut")) | (F.col("_n") < min_keep)).drop("_cut", "_n")


def frame_rms(points: DataFrame) -> DataFrame:
    return points.groupBy("frame").agg(F.round(F.sqrt(F.avg(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), 4).alias("rms"))


def rank_frames(errors: DataFrame, value: str = "rms") -> DataFrame:
    """Worst first; a row for each frame."""
    return rank_descending(errors, value)


def raster_profile(cells: DataFrame, cell: float = 1.0) -> DataFrame:
    return cells.agg((F.max("row") - F.min("row") + 1).alias("n_rows"), (F.max("col") - F.min("col") + 1).alias("n_cols"), F.round(100 * F.count_if(F.col("value").isNull()) / F.count("*"), 2).alias("nodata_pct"), F.min("value").alias("least"), F.max("value").alias("most"), F.lit(cell).alias("resolution"))


def vector_profile(geometry: DataFrame) -> DataFrame:
    return geometry.agg(F.count("*").alias("n_features"), F.round(F.sum("area_m2"), 2).alias("total_area_m2"))


def table_profile(df: DataFrame) -> DataFrame:
    full = F.lit(True)
    for c in df.columns:
        full &= F.col(c).isNotNull()
    missing = sum(F.count_if(F.col(c).isNull()) for c in df.columns)
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.count_if(full).alias("complete"), F.round(100 * missing / (F.count("*") * len(df.columns)), 2).alias("missing_pct"))


def validate_raster(cells: DataFrame, low: float, high: float, max_nodata: float = 20.0) -> DataFrame:
    """Warnings (level, step, message)."""
    one = cells.agg((100 * F.count_if(F.col("value").isNull()) / F.count("*")).alias("gaps"), F.min("value").alias("a"), F.max("value").alias("z"))
    rows = F.filter(F.array(F.when(F.col("gaps") > max_nodata, F.lit("too many cells without data")), F.when(F.col("a") < low, F.lit("values below the expected range")), F.when(F.col("z") > high, F.lit("values above the expected range"))), lambda x: x.isNotNull())
    return one.select(F.lit("warning").alias("level"), F.lit("validate_raster").alias("step"), F.explode(rows).alias("message"))


def validate_vector(audit: DataFrame) -> DataFrame:
    one = audit.agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("bad"), F.count_if(F.col("empty_rings") > 0).alias("empty"))
    row = lambda bad, level, message, n: F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(message).alias("message"), F.col(n).alias("n")))
    rows = F.filter(F.array(row(F.col("n") == 0, "critical", "no feature", "n"), row(F.col("bad") > 0, "warning", "invalid features", "bad"), row(F.col("empty") > 0, "warning", "features without area", "empty")), lambda x: x.isNotNull())
    return one.select(F.explode(rows).alias("r")).select("r.*")


def validate_boundaries(audit: DataFrame, geometry: DataFrame, min_ha: float) -> DataFrame:
    """Valid features of at least ``min_ha``."""
    return geometry.join(audit.where("valid").select("feature_id"), "feature_id", "left_semi").where(F.col("area_ha") >= min_ha)


def check_alignment(overlap: DataFrame, geometry: DataFrame, same_crs: bool, cell: float, min_overlap: float = 80.0) -> DataFrame:
    """One row: same system, overlap high enough, share of features of at least one cell."""
    size = geometry.agg(F.round(F.avg((F.col("area_m2") >= cell * cell).cast("int")), 4).alias("resolved"))
    return overlap.select(F.lit(same_crs).alias("same_crs"), (F.col("overlap_pct") >= min_overlap).alias("overlap_ok")).crossJoin(size)


def survey_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("agreement"), 4).alias("agreement"))
