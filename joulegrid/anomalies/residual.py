"""Detector C: forecast errors that are large against the sensor's recent errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from joulegrid.operators import joins, series as ser

METHOD = "forecast_residual"
VERSION = "v1"
STD_ROWS = 72
MIN_DENOMINATOR = 0.1


def residuals(joined: DataFrame, std_rows: int = STD_ROWS, chunk_rows: int = ser.CHUNK_HOURS) -> DataFrame:
    """Absolute, relative and standardised residual of every scored row.

    The frame counts scored rows, not hours, so rows are numbered per sensor first and
    then cut into chunks of positions that overlap by the frame.
    """
    error = F.col("actual_kwh") - F.col("predicted_kwh")
    base = joined.withColumns(
        {
            "absolute_residual": error,
            "relative_residual": error / F.greatest(F.abs("actual_kwh"), F.lit(MIN_DENOMINATOR)),
        }
    )
    chunked = ser.in_position_chunks(ser.with_positions(base, ["sensor_id"], "target_ts"), std_rows, chunk_rows)
    w = Window.partitionBy("sensor_id", "chunk").orderBy("position").rowsBetween(-std_rows, -1)
    std = F.when(F.count("absolute_residual").over(w) == std_rows, F.stddev_samp("absolute_residual").over(w))
    return (
        chunked.withColumn("residual_std", std)
        .where("own")
        .withColumn(
            "standardized_residual",
            F.when(F.col("residual_std") > ser.MIN_SPREAD, F.col("absolute_residual") / F.col("residual_std")),
        )
        .drop("position", "chunk", "own")
    )


def alerts_from(scored: DataFrame, threshold: float, std_rows: int = STD_ROWS) -> DataFrame:
    z, gap = F.col("standardized_residual"), F.col("absolute_residual")
    side = F.when(z > 0, "above").otherwise("below")
    text = F.format_string(
        "Measured %.2f kWh is %s the forecast of %.2f kWh by %.2f kWh, %.1f standard deviations of the sensor's last %d forecast errors.",
        "actual_kwh", side, "predicted_kwh", F.abs(gap), F.abs(z), F.lit(std_rows),
    )
    return scored.where(F.abs(z) >= threshold).select(
        "sensor_id", F.col("target_ts").alias("ts"),
        F.when(z > 0, "high_residual").otherwise("low_residual").alias("anomaly_type"),
        F.when(F.abs(z) >= 2 * threshold, "high").otherwise("medium").alias("severity"),
        F.abs(z).alias("score"), F.col("predicted_kwh").alias("expected_value"), F.col("actual_kwh").alias("actual_value"),
        gap.alias("residual"), text.alias("explanation"), F.lit(METHOD).alias("method"), F.lit(VERSION).alias("detector_version"),
    )


def detect(predictions: DataFrame, readings: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Measured values always come from the readings, never from a copy beside the forecast."""
    return alerts_from(residuals(joins.with_actuals(predictions, readings, keep_missing=False)), threshold)
