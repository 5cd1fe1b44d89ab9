"""Detector metrics against a truth table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from joulegrid.functions import stats
from joulegrid.operators import joins

KEYS = ["sensor_id", "ts"]
RATIOS = ["precision", "recall", "f1", "false_positive_rate", "accuracy"]
# fixed values: threshold grids
Z_GRID = [1.5 + 0.5 * i for i in range(14)]
FOREST_PERCENTS = [80, 85, 90, 93, 95, 97, 98, 99, 99.5, 99.9]


def _with_ratios(counts: DataFrame) -> DataFrame:
    c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    return counts.withColumns(stats.confusion_ratios(**c))


def class_balance(slots: DataFrame, truth: DataFrame) -> DataFrame:
    """Slots (missing ones included), anomalies, rate in percent and sensors touched."""
    total = slots.agg(F.count("*")).scalar()
    return truth.agg(F.count("*").alias("injected_anomalies"), F.countDistinct("sensor_id").alias("affected_sensors")).select(
        total.alias("observation_slots"), "injected_anomalies", (total - F.col("injected_anomalies")).alias("normal_slots"),
        F.bround(F.try_divide(F.col("injected_anomalies") * 100.0, total), 4).alias("anomaly_rate_pct"), "affected_sensors",
    )


def counts_by_type(truth: DataFrame) -> DataFrame:
    return truth.groupBy("anomaly_type").agg(F.count("*").alias("n"))


def confusion(truth: DataFrame, predicted: DataFrame, slots: DataFrame) -> DataFrame:
    """tp, fp, fn, tn and the five ratios of one detector."""
    matched = joins.match_keys(truth, predicted)
    t, p = F.col("in_truth"), F.col("in_predicted")
    counts = matched.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")
    ).withColumn("tn", slots.agg(F.count("*")).scalar() - F.col("tp") - F.col("fp") - F.col("fn"))
    return _with_ratios(counts)


def confusion_by_method(truth: DataFrame, alerts: DataFrame, slots: DataFrame, methods: list[str]) -> DataFrame:
    """Confusion of several detectors from one join; a silent detector keeps its row."""
    flags = truth.select(*KEYS).distinct().withColumn("_hit", F.lit(1))
    joined = alerts.select("method", *KEYS).distinct().join(flags, KEYS, "left")
    counted = joined.groupBy("method").agg(F.count("*").alias("_all"), F.count("_hit").alias("tp"))
    names = alerts.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    wanted = flags.agg(F.count("*")).scalar()
    zero = F.lit(0).cast("long")
    counts = (
        names.join(counted, "method", "left")
        .select("method", F.coalesce("_all", zero).alias("_all"), F.coalesce("tp", zero).alias("tp"))
        .withColumns({"fp": F.col("_all") - F.col("tp"), "fn": wanted - F.col("tp")})
        .withColumn("tn", slots.agg(F.count("*")).scalar() - F.col("tp") - F.col("fp") - F.col("fn"))
        .drop("_all")
    )
    return _with_ratios(counts)


def recall_by_type(truth: DataFrame, predicted: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Found and total injected points per type, per detector of ``methods``; a silent detector has recall 0."""
    keys = ["method"] if methods else []
    found = predicted.select(*keys, *KEYS).distinct()
    hits = truth.join(found, KEYS).groupBy(*keys, "anomaly_type").agg(F.count("*").alias("_tp"))
    totals = counts_by_type(truth)
    if methods:
        totals = totals.select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"), "anomaly_type", "n")
    joined = totals.join(hits, [*keys, "anomaly_type"], "left").withColumn("tp", F.coalesce("_tp", F.lit(0)).cast("long"))
    return joined.select(*keys, "anomaly_type", "n", "tp", F.try_divide(F.col("tp").cast("double"), F.col("n")).alias("recall"))


def sweep(scored: DataFrame, truth: DataFrame, slots: DataFrame, thresholds: list[float]) -> DataFrame:
    """Metrics at every threshold from one pass over the scores.

    A row only records how many thresholds its score reaches; the few resulting counts are
    then spread over those thresholds.
    """
    grid = sorted(thresholds)
    spark = scored.sparkSession
    flags = truth.select(*KEYS).distinct().withColumn("_hit", F.lit(1))
    level = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in grid), F.lit(0))
    counts = (
        scored.where(F.col("score").isNotNull() & (F.col("score") >= grid[0]))
        .select(*KEYS, level.alias("_level"))
        .join(flags, KEYS, "left")
        .groupBy("_level")
        .agg(F.count("*").alias("_all"), F.count("_hit").alias("_tp"))
        .select(F.explode(F.sequence(F.lit(1), F.col("_level"))).alias("_i"), "_all", "_tp")
    )
    base = spark.createDataFrame(
        [(i + 1, float(t)) for i, t in enumerate(grid)], "_i int, threshold double"
    )
    wanted = flags.agg(F.count("*")).scalar()
    population = slots.agg(F.count("*")).scalar()
    zero = F.lit(0).cast("long")
    summed = (
        base.join(counts.groupBy("_i").agg(F.sum("_all").alias("_all"), F.sum("_tp").alias("_tp")), "_i", "left")
        .select("threshold", F.coalesce("_all", zero).alias("_all"), F.coalesce("_tp", zero).alias("tp"))
        .withColumns({"fp": F.col("_all") - F.col("tp"), "fn": wanted - F.col("tp")})
        .withColumn("tn", population - F.col("tp") - F.col("fp") - F.col("fn"))
        .drop("_all")
    )
    return _with_ratios(summed)


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row with the highest F1 (NULL counts as 0); the lower threshold wins a tie."""
    order = F.struct(F.coalesce("f1", F.lit(0.0)), -F.col("threshold"))
    return swept.agg(F.max_by(F.struct(*swept.columns), order).alias("_b")).select("_b.*")


def recall_matrix(recalls: DataFrame, types: list[str]) -> DataFrame:
    """Detector x type table of recalls."""
    return recalls.groupBy("method").pivot("anomaly_type", types).agg(F.first("recall"))
