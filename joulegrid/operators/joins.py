"""Joins between readings, dimensions, weather, forecasts and truth.

A dimension is broadcast to the facts only after its rows were counted; beyond the limit the
sort join applies, with adaptive splitting of skewed keys. Fact-to-fact joins are never hinted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from joulegrid.functions import calendar as cal


BROADCAST_BYTES = 64 * 1024 * 1024


def bounded(side: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``side`` marked for broadcast if its counted rows fit ``limit``, else unchanged.

    Spark's own estimate multiplies the sizes of joined dimensions, so it would rather shuffle
    the facts than broadcast a small joined dimension.
    """
    width = 16 + sum(40 if isinstance(f.dataType, T.StringType) else 16 for f in side.schema.fields)
    return F.broadcast(side) if side.count() * width <= limit else side


def with_dimensions(readings: DataFrame, sensors: DataFrame, buildings: DataFrame, sites: DataFrame) -> DataFrame:
    """Readings with building attributes and zone; unmatched readings keep NULLs."""
    attributes = (
        sensors.select("sensor_id", "building_id")
        .join(buildings.select("building_id", "site_id", "primary_use", "area_sqm"), "building_id", "left")
        .join(sites.select("site_id", F.col("timezone").alias("tz")), "site_id", "left")
    )
    return readings.join(bounded(attributes), "sensor_id", "left")


def drop_unmatched(facts: DataFrame, dimension: DataFrame, code: str, key: str) -> DataFrame:
    """Facts whose code exists in the dimension, with the dimension's key in its place."""
    return facts.join(bounded(dimension.select(code, key)), code).drop(code)


def site_totals(readings: DataFrame, resolved: DataFrame) -> DataFrame:
    """Site total per hour, summed before any further join."""
    return (
        readings.join(bounded(resolved.select("sensor_id", "site_id")), "sensor_id")
        .groupBy("site_id", "ts")
        .agg(F.sum("consumption_kwh").cast("double").alias("site_kwh"))
    )


def site_weather(readings: DataFrame, resolved: DataFrame, weather: DataFrame) -> DataFrame:
    return site_totals(readings, resolved).join(weather, ["site_id", "ts"])


def seasonal_naive(requests: DataFrame, readings: DataFrame, season_hours: int, out: str = "predicted_kwh") -> DataFrame:
    """The reading exactly one season before each target hour, NULL without one."""
    history = readings.select(
        "sensor_id",
        cal.shift_hours(F.col("ts"), season_hours).alias("target_ts"),
        F.col("consumption_kwh").cast("double").alias(out),
    )
    return requests.join(history, ["sensor_id", "target_ts"], "left")


def with_actuals(predictions: DataFrame, readings: DataFrame, keep_missing: bool) -> DataFrame:
    """Predictions beside the measured value.

    ``keep_missing`` is the forecast view: rows without a reading stay, with NULLs.
    Otherwise rows that lack either side are dropped.
    """
    actual = readings.select(
        "sensor_id", F.col("ts").alias("target_ts"), F.col("consumption_kwh").cast("double").alias("actual_kwh")
    )
    joined = predictions.withColumn("predicted_kwh", F.col("predicted_kwh").cast("double")).join(
        actual, ["sensor_id", "target_ts"], "left" if keep_missing else "inner"
    )
    if not keep_missing:
        return joined.dropna(subset=["actual_kwh", "predicted_kwh"])
    return joined.withColumn("residual", F.col("actual_kwh") - F.col("predicted_kwh"))


def overlay(series: DataFrame, replacements: DataFrame) -> DataFrame:
    """The series with the replaced readings written over a copy."""
    new = replacements.select("sensor_id", "ts", F.col("injected_value").alias("_new"))
    return series.join(new, ["sensor_id", "ts"], "left").select(
        "sensor_id", "ts", F.coalesce("_new", "consumption_kwh").alias("consumption_kwh")
    )


def match_keys(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row per key with ``in_truth`` and ``in_predicted``."""
    keys = ["sensor_id", "ts"]
    left = truth.select(*keys, F.lit(1).alias("_t"), F.lit(0).alias("_p"))
    right = predicted.select(*keys, F.lit(0).alias("_t"), F.lit(1).alias("_p"))
    return (
        left.unionByName(right)
        .groupBy(*keys)
        .agg((F.max("_t") == 1).alias("in_truth"), (F.max("_p") == 1).alias("in_predicted"))
    )
