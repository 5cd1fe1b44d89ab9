"""Leakage-safe feature table: one row per (sensor, local-midnight origin, horizon)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from joulegrid.functions import calendar as cal
from joulegrid.operators import lookups, series as ser

LAG_COLUMNS = [f"lag_{k}" for k in ser.LAGS]
ROLLING_COLUMNS = ["rolling_24h_mean", "rolling_24h_std", "rolling_168h_mean"]
IMPUTED = ["number_of_floors", "occupants"]
STATIC = ["building_id", "site_id", "tz", "area_sqm", "primary_use", *IMPUTED]
# floors and occupants may be missing, they are imputed by the models; horizon and the
# calendar columns of an origin are never NULL, so they need no check
REQUIRED_FEATURES = [*LAG_COLUMNS, *ROLLING_COLUMNS, "area_sqm", "primary_use"]
REQUIRED = [*REQUIRED_FEATURES, "target_kwh"]
LOOKBACK_HOURS = max(ser.LAGS)


def static_features(buildings: DataFrame, sensors: DataFrame, sites: DataFrame) -> DataFrame:
    """Per sensor: building attributes and the site's zone."""
    return (
        sensors.where(F.col("meter_type") == "electricity")
        .select("sensor_id", "building_id")
        .join(buildings.select("building_id", "site_id", "primary_use", *[F.col(c).cast("double").alias(c) for c in ("area_sqm", *IMPUTED)]), "building_id")
        .join(sites.select("site_id", F.col("timezone").alias("tz")), "site_id")
        .select("sensor_id", *STATIC)
    )


def origins(readings: DataFrame, static: DataFrame, chunk_hours: int = ser.CHUNK_HOURS) -> DataFrame:
    """Lags, rolling statistics and targets at each sensor's local midnights.

    The 24-fold expansion comes after this filter, so it only meets daily origins.
    """
    chunked = ser.chunked_grid(readings, LOOKBACK_HOURS, max(ser.HORIZONS), chunk_hours, static)
    targets = [f"target_h{h}" for h in ser.HORIZONS]
    midnights = ser.origin_frames(chunked, [*LAG_COLUMNS, *ROLLING_COLUMNS, *targets])
    return midnights.withColumnRenamed("ts", "origin_ts").join(static, "sensor_id")


def expand(origin_rows: DataFrame) -> DataFrame:
    """24 rows per origin with the calendar features of their target hour."""
    keep = ["sensor_id", "origin_ts", *LAG_COLUMNS, *ROLLING_COLUMNS, *STATIC]
    melted = ser.melt_horizons(origin_rows, keep)
    placed = melted.withColumn("_local", cal.local(F.col("target_ts"), F.col("tz")))
    return placed.select("*", *cal.calendar_columns(F.col("_local"))).drop("_local")


def feature_table(readings: DataFrame, static: DataFrame, chunk_hours: int = ser.CHUNK_HOURS) -> DataFrame:
    """All (origin, horizon) rows; nothing dropped."""
    return expand(origins(readings, static, chunk_hours))


def with_split(table: DataFrame, periods: dict[str, tuple]) -> DataFrame:
    """Label rows by the split of their origin; rows outside every period are dropped."""
    label = F.lit(None).cast("string")
    for name, period in periods.items():
        label = F.when(lookups.in_period(F.col("origin_ts"), *period), name).otherwise(label)
    return table.withColumn("split", label).where(F.col("split").isNotNull())


def training_rows(table: DataFrame, periods: dict[str, tuple]) -> DataFrame:
    """Complete rows of all splits."""
    return lookups.complete_cases(with_split(table, periods), REQUIRED)


def usable(origin_rows: DataFrame) -> DataFrame:
    """Origins a model can score: complete but for the targets."""
    return lookups.complete_cases(origin_rows, REQUIRED_FEATURES)


def latest_request(origin_rows: DataFrame) -> DataFrame:
    """The latest usable origin of every sensor, expanded to its 24 horizons.

    A ranking with a limit: every partition is cut to one row per sensor before the exchange.
    """
    rank = F.row_number().over(Window.partitionBy("sensor_id").orderBy(F.col("origin_ts").desc()))
    return expand(usable(origin_rows).withColumn("_rank", rank).where("_rank = 1").drop("_rank"))


def range_request(origin_rows: DataFrame, start, end) -> DataFrame:
    """All usable origins of a half-open range."""
    return expand(usable(origin_rows).where(lookups.in_period(F.col("origin_ts"), start, end)))
