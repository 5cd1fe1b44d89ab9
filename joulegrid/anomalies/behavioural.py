"""Detector B: deviation from the sensor's own recent readings at the same hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from joulegrid.operators import series as ser

METHOD = "behavioral"
VERSION = "v1"
TYPE = "behavioral_deviation"


def scores(readings: DataFrame, days: int = ser.BASELINE_DAYS, chunk_hours: int = ser.CHUNK_HOURS, hours: tuple[int, int] | None = None) -> DataFrame:
    """Every grid hour, or every one of ``hours``, with its baseline median, MAD and robust z (NULL = not scored)."""
    rows = ser.deviation_frames(ser.chunked_grid(readings, 24 * days, 0, chunk_hours), days, hours)
    kind = readings.schema["consumption_kwh"].dataType
    return rows.withColumn("consumption_kwh", F.col("consumption_kwh").cast(kind))


def alerts_from(scored: DataFrame, threshold: float, days: int = ser.BASELINE_DAYS) -> DataFrame:
    z, x, hour = F.col("z_score"), F.col("consumption_kwh").cast("double"), F.hour("ts")
    text = F.format_string(
        "Reading of %.2f kWh at hour %02d:00 is %.1f robust deviations %s the sensor's median of %.2f kWh over its last %d readings of that hour.",
        x, hour, F.abs(z), F.when(z > 0, "above").otherwise("below"), F.col("baseline_median"), F.lit(days),
    )
    return scored.where(F.abs(z) >= threshold).select(
        "sensor_id", "ts", F.lit(TYPE).alias("anomaly_type"),
        F.when(F.abs(z) >= 2 * threshold, "high").otherwise("medium").alias("severity"),
        F.abs(z).alias("score"), F.col("baseline_median").alias("expected_value"), x.alias("actual_value"),
        text.alias("explanation"), F.lit(METHOD).alias("method"), F.lit(VERSION).alias("detector_version"),
    )


def detect(readings: DataFrame, threshold: float = 4.0, days: int = ser.BASELINE_DAYS) -> DataFrame:
    return alerts_from(scores(readings, days), threshold, days)
