"""Model pipelines on Spark ML and the time-ordered search for ridge's penalty."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from joulegrid.forecasting import boosting, forest, ridge as ridge_fit
from joulegrid.forecasting.features import IMPUTED, LAG_COLUMNS, ROLLING_COLUMNS
from joulegrid.functions.calendar import CALENDAR_COLUMNS
from joulegrid.functions.medians import exact_medians
from joulegrid.sources import tables

SEED = 42
ALPHAS = (0.1, 1.0, 10.0, 100.0)
BASELINES = {"seasonal_naive_24h": 24, "seasonal_naive_168h": 168}
OUTPUT = "predicted_kwh"
LABEL = "target_kwh"

_PLAIN = [*CALENDAR_COLUMNS, *LAG_COLUMNS, *ROLLING_COLUMNS, "area_sqm", "horizon"]


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def preprocessing(train: DataFrame, scale: bool) -> list:
    """Stages fitted on training rows only.

    An unknown use gets the indexer's extra slot, which the encoder drops: all zeros.
    """
    mode = train.where(F.col("primary_use").isNotNull()).groupBy("primary_use").count().orderBy(F.col("count").desc(), "primary_use").first()
    use = _quoted(mode[0]) if mode else "''"
    imputed = [f"{c}_filled" for c in IMPUTED]
    filled = [f"coalesce(CAST({c} AS DOUBLE), {(m or 0.0)!r}D) AS {c}_filled" for c, m in exact_medians(train, IMPUTED).items()]
    stages = [
        SQLTransformer(statement=f"SELECT *, coalesce(primary_use, {use}) AS use_filled, {', '.join(filled)} FROM __THIS__"),
        StringIndexer(inputCol="use_filled", outputCol="use_index", handleInvalid="keep"),
        OneHotEncoder(inputCol="use_index", outputCol="use_flags", dropLast=True),
        VectorAssembler(inputCols=[*_PLAIN, *imputed], outputCol="numbers"),
    ]
    numbers = "numbers"
    if scale:
        stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True))
        numbers = "scaled"
    stages.append(VectorAssembler(inputCols=[numbers, "use_flags"], outputCol="features"))
    return stages


def ridge(train: DataFrame, alpha: float) -> LinearRegression:
    """Penalty alpha on the sum of squares.

    Spark minimises the mean of squares and divides the penalty by the label's deviation,
    so alpha is rescaled by both.
    """
    count, spread = train.agg(F.count("*"), F.stddev_pop(LABEL)).first()
    penalty = alpha * (spread or 1.0) / max(count, 1)
    return LinearRegression(
        featuresCol="features", labelCol=LABEL, predictionCol=OUTPUT, regParam=penalty,
        elasticNetParam=0.0, standardization=False, solver="normal",
    )


def random_forest(train: DataFrame, trees: int = 100, depth: int = 20, leaf: int = 5, seed: int = SEED) -> forest.Forest:
    """A fitted forest; every tree sees all features."""
    prepared = Pipeline(stages=preprocessing(train, scale=False)).fit(train)
    return forest.fit(train, prepared, LABEL, OUTPUT, trees=trees, depth=depth, leaf=leaf, seed=seed)


def boosted_trees(train: DataFrame, iterations: int = 100) -> forest.Forest:
    """Fitted boosted trees of 31 leaves each, grown best leaf first over 255 bins."""
    prepared = Pipeline(stages=preprocessing(train, scale=False)).fit(train)
    return boosting.fit(train, prepared, LABEL, OUTPUT, rounds=iterations)


def fit(train: DataFrame, estimator, scale: bool) -> PipelineModel:
    return Pipeline(stages=[*preprocessing(train, scale), estimator]).fit(train)


Model = PipelineModel | forest.Forest


def save(model: Model, path: str) -> None:
    if isinstance(model, forest.Forest):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> Model:
    """A model as :func:`save` wrote it; a forest has a table of nodes."""
    if tables.read_or_none(spark, f"{path}/nodes") is not None:
        return forest.Forest.load(spark, path, OUTPUT)
    return PipelineModel.load(path)


def known_uses(model: Model) -> list[str]:
    """Uses the fitted encoder has seen."""
    return next(list(stage.labels) for stage in model.stages if hasattr(stage, "labels"))


def fold_bounds(train: DataFrame, folds: int = 5) -> list[dict]:
    """Expanding windows over distinct origins: fold k trains on the first k of folds+1 blocks.

    Only the origins, one per day and zone, pass through the window.
    """
    blocks = (
        train.select("origin_ts").distinct()
        .withColumn("block", F.ntile(folds + 1).over(Window.orderBy("origin_ts")))
        .groupBy("block").agg(F.min("origin_ts").alias("first"), F.max("origin_ts").alias("last"))
        .orderBy("block").collect()
    )
    return [
        {"fold": k, "train_last": blocks[k]["last"], "valid_first": blocks[k + 1]["first"], "valid_last": blocks[k + 1]["last"]}
        for k in range(len(blocks) - 1)
    ]


def ridge_products(train: DataFrame, folds: int = 5) -> tuple[ridge_fit.Products, list[dict]]:
    """Summed products per block of origins, and the windows that the blocks make."""
    bounds = fold_bounds(train, folds)
    block = F.lit(len(bounds))
    for b in reversed(bounds):
        block = F.when(F.col("origin_ts") <= F.lit(b["train_last"]), b["fold"]).otherwise(block)
    return ridge_fit.products(train, block, _PLAIN, IMPUTED, "primary_use", LABEL, len(bounds) + 1), bounds


def search_alpha(train: DataFrame, alphas=ALPHAS, folds: int = 5) -> tuple[float, list[dict]]:
    """Ridge penalty with the lowest mean validation RMSE over expanding windows."""
    return _searched(*ridge_products(train, folds), alphas)


def _searched(products: ridge_fit.Products, bounds: list[dict], alphas) -> tuple[float, list[dict]]:
    found = ridge_fit.search(products, alphas, len(bounds))
    results = [{"alpha": alpha, **bounds[k], "rmse": rmse} for k, alpha, rmse in found]
    mean = {a: sum(x["rmse"] for x in results if x["alpha"] == a) for a in alphas}
    return min(alphas, key=lambda a: (mean[a], a)), results


def fit_ridge(train: DataFrame, alphas=ALPHAS, folds: int = 5) -> tuple[PipelineModel, float, list[dict]]:
    """The model with the searched penalty over all training rows: search and fit share one scan."""
    products, bounds = ridge_products(train, folds)
    alpha, results = _searched(products, bounds, alphas)
    fitted = ridge_fit.solve(products, len(bounds), alpha)
    return ridge_fit.model(products, fitted, "primary_use", OUTPUT), alpha, results
