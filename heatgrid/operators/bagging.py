"""Bags of trees whose draws are known, and their out-of-bag scores.

MLlib's forests keep their draws to themselves. Here tree t counts a row by a Poisson(1) weight drawn from a hash of the
row's id and t, so whether a row is out of a tree's bag is a column expression, whenever and wherever it is asked. Each
tree is a forest of one without a bootstrap of its own, and all trees vote in one projection over the rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.operators.checks import require_columns
from heatgrid.operators.sampling import poisson


class Bag(NamedTuple):
    models: list[Model]
    features: list[str]
    label: str
    id_col: str
    seed: int
    regression: bool


def times_drawn(bag_seed: int, tree: int, id_col: str) -> Column:
    """How often a tree's bag holds a row."""
    return poisson(F.xxhash64(F.col(id_col), F.lit(tree), F.lit(bag_seed)))


def train_bag(df: DataFrame, label: str, features: list[str], id_col: str = "id", trees: int = 20, depth: int = 5, seed: int = 42, regression: bool = False) -> Bag:
    """Trees on rows without nulls in label and features; each split looks at a share of the features, as in a forest."""
    rows = require_columns(df, id_col, label, *features).dropna(subset=[label, *features])
    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(rows).select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_label"), "_features").repartition("_id").persist()  # a small file would be one task
    if not regression and rows.select("_label").distinct().limit(2).count() < 2:
        raise ValueError("a classifier needs two classes")
    kind = RandomForestRegressor if regression else RandomForestClassifier
    models = []
    for t in range(trees):
        own = kind(featuresCol="_features", labelCol="_label", weightCol="_w", numTrees=1, maxDepth=depth, bootstrap=False, featureSubsetStrategy="onethird" if regression else "sqrt", seed=seed + t)
        models.append(own.fit(rows.withColumn("_w", times_drawn(seed, t, "_id").cast("double")).where("_w > 0")))
    rows.unpersist()
    return Bag(models, features, label, id_col, seed, regression)


def _voted(bag: Bag, df: DataFrame) -> DataFrame:
    """``df`` with ``_votes``, the prediction of each tree."""
    columns = df.columns
    rows = VectorAssembler(inputCols=bag.features, outputCol="_features").transform(require_columns(df, *bag.features).dropna(subset=bag.features))
    for t, model in enumerate(bag.models):
        model = model.copy()
        model.setPredictionCol(f"_p{t}")
        if not bag.regression:
            model.setProbabilityCol("").setRawPredictionCol("")
        rows = model.transform(rows)
    return rows.select(*columns, F.array(*[F.col(f"_p{t}") for t in range(len(bag.models))]).alias("_votes"))


def _decision(votes: Column, regression: bool) -> Column:
    """Mean, or most frequent class (the lowest of equal ones); null without votes."""
    if regression:
        return F.when(F.size(votes) > 0, F.aggregate(votes, F.lit(0.0), lambda a, v: a + v) / F.size(votes))
    counts = F.transform(F.array_distinct(votes), lambda c: F.struct(F.size(F.filter(votes, lambda v: v == c)).alias("n"), (-c).alias("c")))
    return -F.array_max(counts)["c"]


def apply_bag(bag: Bag, df: DataFrame) -> DataFrame:
    """``df`` with ``pred`` of all trees."""
    return _voted(bag, df).withColumn("pred", _decision(F.col("_votes"), bag.regression)).drop("_votes")


def oob_predictions(bag: Bag, df: DataFrame) -> DataFrame:
    """(id, truth, pred, trees) of the rows that some tree's bag left out, by those trees alone."""
    rows = _voted(bag, df.dropna(subset=[bag.label]).repartition(bag.id_col))
    out_of = F.array(*[times_drawn(bag.seed, t, bag.id_col) == 0 for t in range(len(bag.models))])
    left = F.filter(F.arrays_zip(F.col("_votes").alias("v"), out_of.alias("o")), lambda z: z["o"])
    rows = rows.withColumn("_left", F.transform(left, lambda z: z["v"])).where(F.size("_left") > 0)
    return rows.select(F.col(bag.id_col).alias("id"), F.col(bag.label).cast("double").alias("truth"), _decision(F.col("_left"), bag.regression).alias("pred"), F.size("_left").alias("trees"))


def oob_score(bag: Bag, df: DataFrame) -> DataFrame:
    """One row: n, and accuracy or R2 out of the bag."""
    rows = oob_predictions(bag, df)
    if not bag.regression:
        return rows.agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("oob_accuracy"))
    total = F.var_pop("truth") * F.count("*")
    return rows.agg(F.count("*").alias("n"), F.when(total > 0, 1 - F.sum(F.pow(F.col("truth") - F.col("pred"), 2)) / total).alias("oob_r2"))
