"""Tree, linear and logistic models on MLlib, bound to columns by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.operators.checks import require_columns
from heatgrid.operators.spatial import checkpointed
from heatgrid.sources.shared import new_folder

CLASSIFIERS = {
    "rf": lambda trees: RandomForestClassifier(numTrees=trees or 200, seed=42),
    "gbt": lambda trees: OneVsRest(classifier=GBTClassifier(maxIter=trees or 50, seed=42)),
    "logistic": lambda trees: LogisticRegression(maxIter=1000),
}
REGRESSORS = {
    "rf": lambda trees: RandomForestRegressor(numTrees=trees or 300, seed=42),
    "gbt": lambda trees: GBTRegressor(maxIter=trees or 100, seed=42),
    "linear": lambda trees: LinearRegression(solver="normal"),
}


def register_estimator(name: str, make: Callable[[int | None], Estimator], regression: bool = False) -> None:
    """Make an estimator known by ``name`` to the functions here; ``make`` takes the number of trees or rounds, or None."""
    (REGRESSORS if regression else CLASSIFIERS)[name] = make


def _estimator(kinds: dict, name: str, trees: int | None) -> Estimator:
    if name not in kinds:
        raise ValueError(f"no estimator {name!r}; there are {sorted(kinds)}")
    return kinds[name](trees)


def feature_columns(df: DataFrame, label: str, exclude: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c != label and c not in exclude]


def train_classifier(df: DataFrame, label: str, features: list[str] | None = None, estimator: str = "rf", trees: int | None = None, balanced: bool = False) -> PipelineModel:
    """At least two classes; ``balanced`` weighs rows by the inverse of their class's share (not for gbt). Boosted trees are
    fitted for the classes that there are, by their place among them; the model gives the labels back."""
    features = features or feature_columns(df, label, ("id", "frame", "frame_id", "partition", "x", "y"))
    rows = require_columns(df, label, *features).dropna(subset=[label, *features])
    if rows.select(label).distinct().limit(2).count() < 2:
        raise ValueError("a classifier needs two classes")
    model = _estimator(CLASSIFIERS, estimator, trees)
    model.setLabelCol(label).setFeaturesCol("features")
    if balanced and estimator != "gbt":
        share = rows.groupBy(label).agg(F.count("*").alias("_c"))
        total = rows.agg(F.count("*").alias("_t"), F.count_distinct(label).alias("_k"))
        rows = rows.join(share, label).crossJoin(F.broadcast(total)).withColumn("_w", F.col("_t") / (F.col("_k") * F.col("_c")))
        model.setWeightCol("_w")
    stages = [VectorAssembler(inputCols=features, outputCol="features"), model]
    if isinstance(model, OneVsRest):  # which fits a model for each number up to the largest label
        known = sorted(r[0] for r in rows.select(F.col(label).cast("double")).distinct().collect())  # a row for each class
        rows = rows.withColumn(label, F.array_position(F.array(*[F.lit(k) for k in known]), F.col(label).cast("double")).cast("double") - 1)
        stages.append(SQLTransformer(statement=f"SELECT * EXCEPT (prediction), element_at(array({', '.join(f'{k!r}D' for k in known)}), CAST(prediction AS INT) + 1) AS prediction FROM __THIS__"))
    fitted = Pipeline(stages=stages).fit(rows).copy()
    # a training summary would take the session, unserializable once it has observed, to the tasks; forests' copies have none
    if any(getattr(m, "hasSummary", False) for m in fitted.stages):
        path = new_folder(df.sparkSession, "models")
        fitted.save(path)
        fitted = PipelineModel.load(path)
    return fitted


def apply_classifier(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``pred`` and ``confidence``, the largest probability (null where the model has none)."""
    features = model.stages[0].getInputCols()
    out = model.transform(require_columns(df, *features).dropna(subset=features))
    confidence = F.round(F.array_max(vector_to_array("probability")), 4) if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(*df.columns, F.col("prediction").cast("int").alias("pred"), confidence.alias("confidence"))


def train_regressor(df: DataFrame, target: str, features: list[str] | None = None, estimator: str = "rf", trees: int | None = None) -> PipelineModel:
    features = features or feature_columns(df, target, ("id", "x", "y", "partition"))
    rows = require_columns(df, target, *features).dropna(subset=[target, *features])
    model = _estimator(REGRESSORS, estimator, trees)
    model.setLabelCol(target).setFeaturesCol("features")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model]).fit(rows)


def apply_regressor(model: PipelineModel, df: DataFrame) -> DataFrame:
    features = model.stages[0].getInputCols()
    return model.transform(require_columns(df, *features).dropna(subset=features)).select(*df.columns, F.col("prediction").alias("pred"))


def importances(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, weight): coefficients or importances."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in zip(model.stages[0].getInputCols(), values.toArray(), strict=True)], "feature string, weight double")


def cv_score(df: DataFrame, label: str, features: list[str], estimator: str = "rf", trees: int = 20, folds: int = 3, regression: bool = False) -> float:
    """Mean score of k-fold cross-validation, in place of out-of-bag scores, which MLlib has not."""
    model = _estimator(REGRESSORS if regression else CLASSIFIERS, estimator, trees).setLabelCol(label).setFeaturesCol("features")
    judge = RegressionEvaluator(labelCol=label, metricName="r2") if regression else MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=[label, *features]))
    grid = ParamGridBuilder().addGrid(model.featuresCol, ["features"]).build()  # not empty, so that models are copied, as in train_classifier
    cv = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=42)
    return float(cv.fit(rows).avgMetrics[0])


def segment_pixels(pixels: DataFrame, features: list[str], label: str = "label", model: PipelineModel | None = None, min_labeled: int = 20) -> DataFrame:
    """Class of every pixel by a given model, or by one fitted on the labelled pixels (code 0: none)."""
    if model is None:
        pixels = checkpointed(pixels)  # training reads them many times
        known = pixels.where(F.col(label).isNotNull() & (F.col(label) != 0))
        if known.limit(min_labeled).count() < min_labeled:
            raise ValueError(f"fewer than {min_labeled} labelled pixels")
        model = train_classifier(known, label, features, "rf", 20)
    return apply_classifier(model, pixels)
