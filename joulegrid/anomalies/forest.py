"""Detector D: isolation forest (Liu, Ting and Zhou, 2008) fitted and scored on Spark.

Each tree sees at most 256 rows, so a tree is one small Arrow group; the whole forest is a
node table of bounded size. Only the sampling and the scoring touch all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from joulegrid.functions import calendar as cal
from joulegrid.operators import lookups, series as ser

# fixed values: names, sizes and feature order of the detector
METHOD = "isolation_forest"
VERSION = "v1"
SEED = 42
TREES = 200
SAMPLE = 256

FEATURES = [
    "consumption_kwh", "prev_hour_kwh", "rolling_24h_mean", "rolling_24h_std", "rolling_168h_mean",
    "behavioral_z", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
]
NODES = "tree int, node int, feature int, threshold double, left int, right int, path double"


# --- features -----------------------------------------------------------------------

def features(readings: DataFrame, chunk_hours: int = ser.CHUNK_HOURS, hours: tuple[int, int] | None = None) -> DataFrame:
    """All grid hours, or all of ``hours``, with the ten inputs, NULL where a warm-up is not satisfied.

    Hour and weekday are those of UTC, the week starting on Monday.
    """
    rows = ser.baseline_frames(ser.chunked_grid(readings, 24 * ser.BASELINE_DAYS, 0, chunk_hours), hours)
    hs, hc = cal.cyclic(F.hour("ts"), 24)
    ds, dc = cal.cyclic(F.weekday("ts"), 7)
    return rows.select(
        "sensor_id", "ts", "consumption_kwh", F.col("lag_2").alias("prev_hour_kwh"),
        "rolling_24h_mean", "rolling_24h_std", "rolling_168h_mean", F.col("z_score").alias("behavioral_z"),
        hs.alias("hour_sin"), hc.alias("hour_cos"), ds.alias("dow_sin"), dc.alias("dow_cos"),
    )


def complete(rows: DataFrame) -> DataFrame:
    return lookups.complete_cases(rows, FEATURES)


# --- scaling ------------------------------------------------------------------------

def scaling(train: DataFrame) -> DataFrame:
    """One row of feature means and population deviations."""
    return train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"std_{c}") for c in FEATURES]
    )


def with_scaled(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Add the array of standardised features; a constant feature only loses its mean."""
    s = scales.first()
    columns = []
    for c in FEATURES:
        std = s[f"std_{c}"]
        columns.append((F.col(c) - F.lit(s[f"mean_{c}"])) / F.lit(std if std else 1.0))
    return rows.withColumn("scaled", F.array(*columns))


# --- fit ----------------------------------------------------------------------------

def expected_path(n: int) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(points: np.ndarray, tree: int, rng: np.random.Generator) -> list[tuple]:
    """Random splits down to single points or the depth limit; leaves carry their path length."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[list] = []
    pending = [(np.arange(len(points)), 0, -1, False)]
    while pending:
        rows, depth, parent, is_right = pending.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][5 if is_right else 4] = number
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([tree, number, -1, 0.0, -1, -1, depth + expected_path(len(rows))])
            continue
        column = int(rng.choice(usable))
        # a draw equal to the maximum would leave the right side empty
        at = min(rng.uniform(low[column], high[column]), np.nextafter(high[column], low[column]))
        nodes.append([tree, number, column, float(at), -1, -1, 0.0])
        below = points[rows, column] <= at
        pending.append((rows[below], depth + 1, number, False))
        pending.append((rows[~below], depth + 1, number, True))
    return [tuple(n) for n in nodes]


def sample(train: DataFrame, trees: int = TREES, size: int = SAMPLE, seed: int = SEED, total: int | None = None) -> DataFrame:
    """``size`` rows per tree, the first by a hash of the row's key, the tree and the seed.

    A row is copied only to trees for which its draw lies below a share that leaves each tree about four
    times the rows it needs (all of them, in a table smaller than that); the rank per tree then takes the
    exact number. The rows chosen are those of a ranking of all rows, at every table size.
    """
    total = train.count() if total is None else total
    share = min(1.0, 4.0 * size / max(total, 1) + 16.0 / max(total, 1))
    # exploded numbers and hashes are compiled code; a function over an array of draws is interpreted draw by draw
    draw = F.pmod(F.xxhash64("sensor_id", F.unix_timestamp("ts"), "tree", F.lit(seed), F.lit("cut")), F.lit(1 << 40)) / float(1 << 40)
    offered = train.select("sensor_id", "ts", "scaled", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = offered.withColumn("_draw", draw).where(F.col("_draw") < share)
    place = F.row_number().over(Window.partitionBy("tree").orderBy("_draw", "sensor_id", "ts"))
    return rows.withColumn("_place", place).where(F.col("_place") <= size).select("tree", "sensor_id", "ts", "scaled")


def fit(train: DataFrame, trees: int = TREES, size: int = SAMPLE, seed: int = SEED, total: int | None = None) -> DataFrame:
    """Node table of the forest from standardised training rows."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sensor_id", "ts"])
        tree = int(pdf["tree"].iloc[0])
        points = np.vstack(pdf["scaled"].to_numpy())
        nodes = _grow(points, tree, np.random.default_rng([seed, tree]))
        return pd.DataFrame(nodes, columns=[c.split(" ")[0] for c in NODES.split(", ")])

    return sample(train, trees, size, seed, total).groupBy("tree").applyInPandas(build, NODES)


# --- score --------------------------------------------------------------------------

def _packed(forest: pd.DataFrame) -> list[tuple]:
    """Arrays per tree, the children of place i at 2i + 1 and 2i + 2, so all rows take the same number of steps.

    What would lie below a leaf repeats its path length down to the last level.
    """
    trees = []
    for _, tree in forest.sort_values(["tree", "node"]).groupby("tree"):
        given = [tree[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")]
        levels, places = 0, [[(0, 0)]]  # per level (place, node)
        while below := [child for at, node in places[levels] if given[0][node] >= 0 for child in ((2 * at + 1, given[2][node]), (2 * at + 2, given[3][node]))]:
            places.append(below)
            levels += 1
        inner, last = (1 << levels) - 1, 1 << levels
        feature, threshold, path = np.zeros(inner, dtype=np.int64), np.zeros(inner), np.empty(last)
        for level, found in enumerate(places):
            for at, node in found:
                if given[0][node] >= 0:
                    feature[at], threshold[at] = given[0][node], given[1][node]
                else:
                    span = 1 << (levels - level)
                    path[(at + 1) * span - 1 - inner :][:span] = given[4][node]
        trees.append((feature, threshold, path, levels))
    return trees


def score(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Add ``score`` = 2^(-mean path / c(size)); higher is more anomalous.

    The node table has at most trees x (2 x 256 - 1) rows, so it is broadcast.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_packed(nodes.toPandas()))
    normal = expected_path(size) or 1.0

    @F.pandas_udf("double")
    def depth_score(scaled: pd.Series) -> pd.Series:
        if not len(scaled):
            return pd.Series([], dtype=float)
        points = np.vstack(scaled.to_numpy())
        rows, width = points.shape
        flat, starts = points.ravel(), np.arange(rows, dtype=np.int64) * width
        total, at, place = np.zeros(rows), np.zeros(rows, dtype=np.int64), np.empty(rows, dtype=np.int64)
        value, limit, below = np.empty(rows), np.empty(rows), np.empty(rows, dtype=bool)
        for feature, threshold, path, levels in shared.value:
            at[:] = 0
            for _ in range(levels):
                # every place is inside its array; clipping lets take write where it is told
                feature.take(at, out=place, mode="clip")
                place += starts
                flat.take(place, out=value, mode="clip")
                threshold.take(at, out=limit, mode="clip")
                np.less_equal(value, limit, out=below)
                at *= 2
                at += 2
                at -= below
            at -= (1 << levels) - 1
            total += path.take(at)
        return pd.Series(np.exp2(-total / len(shared.value) / normal))

    return rows.withColumn("score", depth_score("scaled"))


# --- model on disk ------------------------------------------------------------------

def fit_and_save(train_features: DataFrame, path: str, trees: int = TREES, size: int = SAMPLE, seed: int = SEED) -> None:
    """Fit on complete training rows and write scales, nodes and fit-time statistics."""
    spark = train_features.sparkSession
    total = train_features.count()
    if not total:
        raise ValueError("the training period has no complete rows")
    scaling(train_features).write.mode("overwrite").parquet(f"{path}/scales")
    scaled = with_scaled(train_features, spark.read.parquet(f"{path}/scales"))
    fit(scaled, trees, size, seed, total).withColumn("sample_size", F.lit(min(size, total))).write.mode("overwrite").parquet(f"{path}/nodes")
    statistics(score(scaled, *_forest(spark, path))).write.mode("overwrite").parquet(f"{path}/statistics")


def statistics(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("training_rows"), F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std")
    )


def _forest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    from joulegrid.sources.tables import require

    nodes = require(spark, f"{path}/nodes", "the evaluation job, which fits the forest")
    return nodes.drop("sample_size"), nodes.agg(F.max("sample_size")).first()[0]


def score_saved(complete_rows: DataFrame, path: str) -> DataFrame:
    """Score with a stored forest; nothing is fitted."""
    spark = complete_rows.sparkSession
    return score(with_scaled(complete_rows, spark.read.parquet(f"{path}/scales")), *_forest(spark, path))


# --- alerts -------------------------------------------------------------------------

def most_extreme(scaled: str = "scaled") -> Column:
    """(feature index, z) of the largest absolute scaled feature, lowest index on a tie."""
    entries = F.transform(
        F.col(scaled), lambda z, i: F.struct(F.abs(z).alias("size"), (-i).alias("order"), z.alias("z"))
    )
    return F.array_max(entries)


def alerts_from(scored: DataFrame, threshold: float) -> DataFrame:
    worst = most_extreme()
    name = F.get(F.array(*[F.lit(c) for c in FEATURES]), -F.col("_worst.order"))
    text = F.format_string(
        "Isolation score %.3f reaches the threshold %.3f; the most unusual input is '%s', %.1f standard deviations from its training mean.",
        "score", F.lit(float(threshold)), name, F.col("_worst.size"),
    )
    return scored.where(F.col("score") >= threshold).withColumn("_worst", worst).select(
        "sensor_id", "ts", F.lit(METHOD).alias("anomaly_type"),
        F.when(F.col("score") >= 1.5 * threshold, "high").otherwise("medium").alias("severity"),
        "score", F.lit(None).cast("double").alias("expected_value"), F.col("consumption_kwh").alias("actual_value"),
        text.alias("explanation"), F.lit(METHOD).alias("method"), F.lit(VERSION).alias("detector_version"),
    )
