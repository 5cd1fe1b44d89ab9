"""Training, prediction and back-fill jobs."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from joulegrid import schema
from joulegrid.forecasting import features as feat, metrics, models
from joulegrid.operators import aggregates as ag, joins, lookups
from joulegrid.session import written
from joulegrid.sources import tables

VERSION = "v1"
FEATURE_VERSION = "v1"


@dataclass
class Settings:
    """Sizes of the fitted models; the defaults are the published configuration."""

    trees: int = 100
    forest_depth: int = 20
    leaf: int = 5
    boosting_rounds: int = 100
    folds: int = 5
    alphas: tuple[float, ...] = models.ALPHAS
    models: tuple[str, ...] = ("ridge", "random_forest", "gradient_boosting")


def score_baseline(requests: DataFrame, readings: DataFrame, name: str) -> DataFrame:
    return joins.seasonal_naive(requests, readings, models.BASELINES[name], models.OUTPUT)


def score(requests: DataFrame, readings: DataFrame, name: str, model: models.Model | None) -> DataFrame:
    if name in models.BASELINES:
        return score_baseline(requests, readings, name)
    return model.transform(requests)


def prediction_rows(scored: DataFrame, name: str, version: str = VERSION) -> DataFrame:
    """Prediction table rows; the origin is the moment of the forecast, NULL forecasts are dropped."""
    return scored.where(F.col(models.OUTPUT).isNotNull()).select(
        "sensor_id", "target_ts", F.lit(name).alias("model_name"), F.lit(version).alias("model_version"),
        F.col("origin_ts").alias("generated_at"), F.col("horizon").cast("int").alias("horizon"), models.OUTPUT,
    )


def predict_latest(origins: DataFrame, readings: DataFrame, name: str, model: models.Model | None = None) -> DataFrame:
    """The next 24 hours of every sensor from its latest usable origin."""
    return prediction_rows(score(feat.latest_request(origins), readings, name, model), name)


def latest_origins(spark: SparkSession, path: str, static: DataFrame) -> DataFrame:
    """The latest usable origin of every sensor in a store of readings partitioned by month.

    Months are searched backwards. Each step reads one month and, for the look-back, the one before it, and goes
    on only with sensors that have no origin yet; a store that is up to date is read for its last two months.
    """
    store = tables.require(spark, path, "the ingestion job").withColumn(tables.MONTH, F.col(tables.MONTH).cast("string"))
    months = sorted((m[0] for m in store.select(tables.MONTH).distinct().collect()), reverse=True)  # bounded by the calendar
    left, found = written(static), None
    for i, month in enumerate(months):
        before = [m for m in months[i + 1 : i + 2]]
        readings = store.where(F.col(tables.MONTH).isin([month, *before])).join(left.select("sensor_id"), "sensor_id", "left_semi").drop(tables.MONTH)
        usable = feat.usable(feat.origins(readings, left)).where(F.date_format("origin_ts", "yyyy-MM") == month)
        rank = F.row_number().over(Window.partitionBy("sensor_id").orderBy(F.col("origin_ts").desc()))
        here = written(usable.withColumn("_rank", rank).where("_rank = 1").drop("_rank"))
        found = here if found is None else found.unionByName(here)
        left = written(left.join(here.select("sensor_id"), "sensor_id", "left_anti"))
        if left.isEmpty():
            break
    if found is None:
        raise ValueError("the store of readings is empty")
    return found


def predict_latest_stored(spark: SparkSession, path: str, static: DataFrame, name: str, model: models.Model | None = None) -> DataFrame:
    """The next 24 hours of every sensor, from the newest months of a store of readings."""
    origins = latest_origins(spark, path, static)
    readings = tables.require(spark, path, "the ingestion job").drop(tables.MONTH)
    return prediction_rows(score(feat.expand(origins), readings, name, model), name)


def backfill(origins: DataFrame, readings: DataFrame, name: str, start, end, model: models.Model | None = None) -> DataFrame:
    """Forecasts of every origin in a half-open range, by a model that is already fitted."""
    return prediction_rows(score(feat.range_request(origins, start, end), readings, name, model), name)


def store_predictions(spark: SparkSession, path: str, predictions: DataFrame) -> dict[str, int]:
    return tables.upsert(
        spark, path, predictions, schema.PREDICTIONS, schema.PREDICTION_KEY, month_of="target_ts",
        update=["generated_at", "predicted_kwh", "horizon"], parts=("model_name", "model_version"),
    )


def stored_predictions(spark: SparkSession, path: str, name: str, version: str = VERSION, start=None, end=None) -> DataFrame:
    """Predictions of one model, for target hours of a half-open range: only its folders and those months are read."""
    rows = tables.require(spark, path, "the prediction job").where((F.col("model_name") == name) & (F.col("model_version") == version))
    if start is not None:
        rows = rows.where((F.col("target_ts") >= F.lit(start).cast("timestamp")) & (F.col(tables.MONTH) >= F.date_format(F.lit(start).cast("timestamp"), "yyyy-MM")))
    if end is not None:
        rows = rows.where((F.col("target_ts") < F.lit(end).cast("timestamp")) & (F.col(tables.MONTH) <= F.date_format(F.lit(end).cast("timestamp"), "yyyy-MM")))
    return rows.select(*[f.name for f in schema.struct(schema.PREDICTIONS).fields])


def _fit(name: str, train: DataFrame, settings: Settings) -> tuple[models.Model, dict, list[dict]]:
    if name == "ridge":
        model, alpha, folds = models.fit_ridge(train, settings.alphas, settings.folds)
        return model, {"alpha": alpha}, folds
    if name == "random_forest":
        shape = {"trees": settings.trees, "depth": settings.forest_depth, "leaf": settings.leaf}
        return models.random_forest(train, **shape), shape, []
    shape = {"iterations": settings.boosting_rounds}
    return models.boosted_trees(train, **shape), shape, []


def train(
    spark: SparkSession, readings: DataFrame, static: DataFrame, periods: dict[str, tuple], out: str, settings: Settings | None = None
) -> dict[str, DataFrame]:
    """Fit all models on the training split, evaluate on validation and test, select one.

    Writes ``dataset``, ``models/<name>``, ``metrics``, ``folds``, ``model_versions`` and
    ``selection`` under ``out``. The feature rows are written once and every fit reads them
    from there, so a lost executor never recomputes the feature job.
    """
    settings = settings or Settings()
    labelled = feat.with_split(feat.feature_table(readings, static), periods)
    labelled.write.mode("overwrite").partitionBy("split").parquet(f"{out}/dataset")
    stored = spark.read.parquet(f"{out}/dataset")
    complete = lookups.complete_cases(stored, feat.REQUIRED)
    training = complete.where(F.col("split") == "train").drop("split")
    held_out = complete.where(F.col("split").isin("validation", "test"))
    keep = ["split", "sensor_id", "origin_ts", "target_ts", "horizon", "building_id", "site_id", "primary_use", models.LABEL, models.OUTPUT]

    folds: list[dict] = []
    registry: list[tuple] = []
    for name in [*models.BASELINES, *settings.models]:
        if name in models.BASELINES:
            model, shape, path = None, {"season_hours": models.BASELINES[name]}, None
        else:
            model, shape, found = _fit(name, training, settings)
            folds += found
            path = f"{out}/models/{name}"
            models.save(model, path)
        scored = score(held_out, readings, name, model).select(F.lit(name).alias("model_name"), *keep)
        scored.write.mode("overwrite").parquet(f"{out}/scored/model={name}")
        registry.append((name, shape, path))

    scored = spark.read.parquet(*[f"{out}/scored/model={name}" for name, _, _ in registry])
    metrics.breakdown_table(scored, models.LABEL, models.OUTPUT, "model_name", "split").write.mode("overwrite").parquet(f"{out}/metrics")
    table = spark.read.parquet(f"{out}/metrics")
    if folds:
        spark.createDataFrame(folds).write.mode("overwrite").parquet(f"{out}/folds")
    comparison = metrics.comparison_table(table)
    metrics.select_model(comparison, list(models.BASELINES)).write.mode("overwrite").parquet(f"{out}/selection")
    record_versions(spark, f"{out}/model_versions", registry, table, periods)
    return {
        "metrics": table,
        "comparison": comparison,
        "retention": ag.retention(stored, "split", feat.REQUIRED),
        "selection": spark.read.parquet(f"{out}/selection"),
    }


def record_versions(spark: SparkSession, path: str, registry: list[tuple], table: DataFrame, periods: dict[str, tuple]) -> None:
    """One registry row per model; the same name and version is replaced."""
    seeds = {True: None, False: models.SEED}
    rows = [
        (name, VERSION, FEATURE_VERSION, json.dumps(shape, sort_keys=True), seeds[name in models.BASELINES], artefact,
         "baseline, nothing is fitted" if artefact is None else "fitted on the training split")
        for name, shape, artefact in registry
    ]
    base = spark.createDataFrame(
        rows, "model_name string, model_version string, feature_version string, hyperparameters string, random_seed int, artifact_path string, notes string"
    )
    figures = table.where("breakdown = 'overall'").groupBy("model_name").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("split", F.struct("n", "mae", "rmse", "r2", "cv_rmse_pct"))))).alias("metrics")
    )
    bounds = {f"{split}_{side}": F.lit(periods[split][i]).cast("timestamp") for split in periods for i, side in enumerate(("start", "end"))}
    tables.upsert(
        spark, path, base.join(figures, "model_name", "left").withColumns(bounds), schema.MODEL_VERSIONS, ["model_name", "model_version"]
    )


def load_model(path: str) -> models.Model:
    return models.load(SparkSession.active(), path)


def selected_model(spark: SparkSession, out: str) -> str:
    chosen = tables.require(spark, f"{out}/selection", "the training job").first()
    if chosen is None:
        raise ValueError("no model beat both baselines in the last training run; name a model explicitly")
    return chosen["model_name"]


def forecast_view(spark: SparkSession, out: str, predictions: DataFrame, readings: DataFrame) -> DataFrame:
    """Forecasts of the selected model beside the readings."""
    name = selected_model(spark, out)
    rows = predictions.where((F.col("model_name") == name) & (F.col("model_version") == VERSION))
    return joins.with_actuals(rows, readings, keep_missing=True)
