"""Detector A: fixed data-quality rules on the hourly grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from joulegrid.functions import calendar as cal
from joulegrid.operators import series as ser

METHOD = "data_quality"
VERSION = "v1"

# fixed values of the rules
MIN_ZERO_RUN = 3
MIN_STUCK_RUN = 30
SPIKE_REACH = 3
SPIKE_FACTOR = 4.0
SPIKE_NEIGHBOUR_FACTOR = 2.5
SPIKE_MIN_KWH = 1.0


def add_spike_columns(chunked: DataFrame) -> DataFrame:
    """Median of up to six neighbours, direct neighbours and the isolation test."""
    w, x = ser.in_chunk(), F.col("consumption_kwh").cast("double")
    steps, most = range(1, SPIKE_REACH + 1), 2 * SPIKE_REACH
    around = [F.lag(x, k).over(w) for k in steps] + [F.lead(x, k).over(w) for k in steps]
    staged = chunked.withColumns({f"_n{i}": value for i, value in enumerate(around)}).withColumns(
        {
            "_around": F.sort_array(F.array(*[f"_n{i}" for i in range(most)])),
            "_present": sum((F.col(f"_n{i}").isNotNull().cast("int") for i in range(most)), F.lit(0)),
            "left_kwh": F.col("_n0"),
            "right_kwh": F.col(f"_n{SPIKE_REACH}"),
        }
    )
    # NULLs sort first, so the present values are the last ones of the array
    first, n = most - F.col("_present"), F.col("_present")
    low = first + F.floor((n - 1) / 2).cast("int")
    high = first + F.floor(n / 2).cast("int")
    staged = staged.withColumn("neighbour_median", F.when(n > 0, (F.get("_around", low) + F.get("_around", high)) / 2))
    # a missing neighbour is NULL, which also rules out the first and last row
    median = F.col("neighbour_median")
    isolated = (
        (x >= SPIKE_MIN_KWH)
        & (median > 0)
        & (x >= SPIKE_FACTOR * median)
        & (F.col("left_kwh") < SPIKE_NEIGHBOUR_FACTOR * median)
        & (F.col("right_kwh") < SPIKE_NEIGHBOUR_FACTOR * median)
    )
    return staged.withColumn("is_spike", F.coalesce(isolated, F.lit(False))).drop(
        "_around", "_present", *[f"_n{i}" for i in range(most)]
    )


def _candidate(kind: str, severity: Column, score: Column, expected: Column | None, text: Column) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        (-score).alias("rank"),
        F.lit(kind).alias("anomaly_type"),
        severity.alias("severity"),
        score.alias("score"),
        (none if expected is None else expected).alias("expected_value"),
        F.col("consumption_kwh").cast("double").alias("actual_value"),
        text.alias("explanation"),
    )


def detect(readings: DataFrame, chunk_hours: int = ser.CHUNK_HOURS) -> DataFrame:
    """Alerts for negative, missing, zero-run, stuck-meter and isolated-spike readings.

    All rules look at the same row of the same ordered chunk, so the best of a row's
    candidates is chosen inside the row and no further shuffle is needed.
    """
    chunked = add_spike_columns(ser.chunked_grid(readings, SPIKE_REACH, SPIKE_REACH, chunk_hours))
    rows = ser.equal_runs(chunked, chunk_hours)
    x, run = F.col("consumption_kwh").cast("double"), F.col("run_length")
    span = F.concat(F.lit("("), F.col("run_start").cast("string"), F.lit(" to "), F.col("run_end").cast("string"), F.lit(")"))
    ts = cal.from_hour_number(F.col("hour_no"))
    ratio = F.try_divide(x, F.col("neighbour_median"))
    flags = {
        "negative_value": F.coalesce(x < 0, F.lit(False)),
        "missing": x.isNull(),
        "zero_run": F.coalesce((x == 0) & (run >= MIN_ZERO_RUN), F.lit(False)),
        "stuck_meter": F.coalesce((x > 0) & (run >= MIN_STUCK_RUN), F.lit(False)),
        "isolated_spike": F.col("is_spike"),
    }
    details = {
        "negative_value": (
            F.lit("high"), F.abs(x), F.lit(0.0),
            F.format_string("Reading of %.2f kWh is negative, which an electricity meter cannot record.", x),
        ),
        "missing": (
            F.lit("medium"), F.lit(1.0), None,
            F.concat(F.lit("No reading at "), ts.cast("string"), F.lit(": the hourly grid has a gap.")),
        ),
        "zero_run": (
            F.lit("medium"), run.cast("double"), None,
            F.concat(F.format_string("Exactly 0 kWh for %d consecutive hours ", run), span, F.lit(".")),
        ),
        "stuck_meter": (
            F.lit("medium"), run.cast("double"), None,
            F.concat(F.format_string("Reading stays at %.4f kWh for %d consecutive hours ", x, run), span, F.lit(".")),
        ),
        "isolated_spike": (
            F.when(ratio >= 2 * SPIKE_FACTOR, "high").otherwise("medium"), ratio, F.col("neighbour_median"),
            F.format_string(
                "Reading of %.2f kWh is %.1fx the local median of %.2f kWh; the hours before (%.2f kWh) and after (%.2f kWh) are not raised.",
                x, ratio, F.col("neighbour_median"), F.col("left_kwh"), F.col("right_kwh"),
            ),
        ),
    }
    flagged = rows.where(reduce(lambda a, b: a | b, flags.values()))
    found = [F.when(flag, _candidate(kind, *details[kind])) for kind, flag in flags.items()]
    return flagged.select("sensor_id", ts.alias("ts"), F.array_min(F.array(*found)).alias("_best")).select(
        "sensor_id", "ts", "_best.anomaly_type", "_best.severity", "_best.score", "_best.expected_value",
        "_best.actual_value", "_best.explanation", F.lit(METHOD).alias("method"), F.lit(VERSION).alias("detector_version"),
    )


def top_alert(candidates: DataFrame) -> DataFrame:
    """One alert per sensor, hour and detector: the highest score, then the type in name order."""
    order = Window.partitionBy("sensor_id", "ts", "method", "detector_version").orderBy(F.col("score").desc(), "anomaly_type")
    return candidates.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
