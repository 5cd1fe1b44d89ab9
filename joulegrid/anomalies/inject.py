"""Labelled benchmark: six anomaly types written over a copy of a period, plus a truth table.

Each sensor's period is cut into 72 h slots. Hashes of (sensor, slot, seed) give a slot its
type, span and size, so every row knows its role without any sequential draw, spans never
overlap, and the same seed gives the same benchmark on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from joulegrid.functions import calendar as cal
from joulegrid.operators import joins, lookups

SLOT_HOURS = 72
# of a period's sensor-slots, the share that gets a span of each type, so prevalence holds at every size:
# 15 spans of a type in the slots that 60 sensors have in three months
RATE = 15 / (60 * 31)
SEEDS = {"validation": 42, "test": 43}

# fixed values: type, shortest and longest span in hours, smallest and largest factor
TYPES = [
    ("spike", 1, 1, 3.0, 6.0),
    ("drop", 1, 1, 0.05, 0.3),
    ("sustained_high", 6, 24, 1.6, 2.5),
    ("sustained_low", 6, 24, 0.2, 0.5),
    ("stuck_meter", 36, 72, None, None),
    ("zero_consumption", 1, 4, None, None),
]


def _uniform(seed: int, purpose: str) -> Column:
    span = 1 << 30
    return F.pmod(F.xxhash64("sensor_id", "_slot", F.lit(seed), F.lit(purpose)), F.lit(span)) / float(span)


def _by_type(values: list) -> Column:
    return F.get(F.array(*[F.lit(v).cast("double") for v in values]), F.col("_type"))


def injections(series: DataFrame, start, end, split: str, seed: int, rate: float = RATE) -> DataFrame:
    """Truth rows for one period: each sensor-slot gets a span of a type with probability ``rate``, if it has room."""
    first_hour = cal.hour_number(F.lit(lookups._bound(start, False).isoformat(" ")).cast("timestamp"))
    rows = series.where(lookups.in_period(F.col("ts"), start, end) & F.col("consumption_kwh").isNotNull())
    staged = (
        rows.select("sensor_id", "ts", F.col("consumption_kwh").cast("double").alias("_x"), (cal.hour_number(F.col("ts")) - first_hour).alias("_h"))
        .withColumn("_slot", F.floor(F.col("_h") / SLOT_HOURS))
        .withColumn("_type", F.floor(_uniform(seed, "type") * len(TYPES)).cast("int"))
    )
    shortest, longest = _by_type([t[1] for t in TYPES]), _by_type([t[2] for t in TYPES])
    staged = staged.withColumn("_hours", F.floor(shortest + _uniform(seed, "hours") * (longest - shortest + 1)))
    staged = staged.withColumn("_from", F.floor(_uniform(seed, "from") * (F.lit(SLOT_HOURS) - F.col("_hours") + 1)))
    place = F.col("_h") - F.col("_slot") * SLOT_HOURS
    inside = staged.where((place >= F.col("_from")) & (place < F.col("_from") + F.col("_hours")))
    # a span must be gap-free; a slot has at most 72 rows
    spans = (
        inside.groupBy("sensor_id", "_slot", "_type", "_hours")
        .agg(F.count("*").alias("_n"), F.min_by("_x", "_h").alias("_held"))
        .where(F.col("_n") == F.col("_hours"))
    )
    chosen = spans.where(_uniform(seed, "rank") < min(1.0, rate * len(TYPES)))
    low, high = _by_type([t[3] for t in TYPES]), _by_type([t[4] for t in TYPES])
    kind = F.get(F.array(*[F.lit(t[0]) for t in TYPES]), F.col("_type"))
    written = (
        F.when(kind == "stuck_meter", F.col("_held"))
        .when(kind == "zero_consumption", F.lit(0.0))
        .otherwise(F.col("_x") * (low + _uniform(seed, "factor") * (high - low)))
    )
    return inside.join(chosen.select("sensor_id", "_slot", "_held"), ["sensor_id", "_slot"]).select(
        "sensor_id", "ts", F.lit(seed).alias("seed"), kind.alias("anomaly_type"),
        F.col("_x").cast("decimal(12,4)").alias("original_value"), written.cast("decimal(12,4)").alias("injected_value"),
        F.lit(split).alias("split"),
    )


def stitched(series: DataFrame, truth: DataFrame) -> DataFrame:
    """The full series with the injected readings in place; all history stays real."""
    return joins.overlay(series, truth)
