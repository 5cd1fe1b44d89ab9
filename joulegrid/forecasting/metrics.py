"""Forecast error metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MIN_GROUP_ROWS = 30
BREAKDOWNS = ["horizon", "building_id", "site_id", "primary_use"]


def metric_columns(actual: str, predicted: str) -> dict[str, Column]:
    """n, MAE, RMSE, R2 and CV(RMSE) % over complete pairs; NULL where undefined."""
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    y = F.when(both, F.col(actual).cast("double"))
    e = y - F.col(predicted).cast("double")
    n, sse = F.count(y), F.sum(e * e)
    rmse = F.sqrt(F.avg(e * e))
    constant = F.min(y) == F.max(y)
    r2 = F.when(n < 2, None).when(constant, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(
        1 - F.try_divide(sse, F.var_pop(y) * n)
    )
    return {
        "n": n,
        "mae": F.avg(F.abs(e)),
        "rmse": rmse,
        "r2": r2,
        "cv_rmse_pct": F.try_divide(rmse, F.avg(y)) * 100,
    }


def overall(rows: DataFrame, actual: str, predicted: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[c.alias(k) for k, c in metric_columns(actual, predicted).items()])


def by_group(rows: DataFrame, actual: str, predicted: str, group: str, *keys: str) -> DataFrame:
    """Metrics per group; small groups keep their row with NULLs and the reason.

    The minimum counts all rows of the group, the reported n of a scored group only pairs.
    """
    columns = metric_columns(actual, predicted)
    grouped = rows.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(
        F.count("*").alias("_rows"), *[c.alias(k) for k, c in columns.items()]
    )
    small = F.col("_rows") < MIN_GROUP_ROWS
    reason = F.concat(F.lit("n="), F.col("_rows").cast("string"), F.lit(f" < minimum {MIN_GROUP_ROWS}"))
    return grouped.select(
        *keys, group,
        F.when(small, F.col("_rows")).otherwise(F.col("n")).alias("n"),
        *[F.when(~small, F.col(k)).alias(k) for k in columns if k != "n"],
        F.when(small, reason).alias("excluded_reason"),
    )


def breakdown_table(scored: DataFrame, actual: str, predicted: str, *keys: str) -> DataFrame:
    """Overall, horizon, building, site and use metrics as one long table, from one scan of the scored rows."""
    columns = metric_columns(actual, predicted)
    grouped = scored.groupingSets([list(keys), *[[*keys, g] for g in BREAKDOWNS]], *keys, *BREAKDOWNS).agg(
        F.count("*").alias("_rows"), *[c.alias(k) for k, c in columns.items()], *[(F.grouping(g) == 0).alias(f"_by_{g}") for g in BREAKDOWNS]
    )
    which, value = F.lit("overall"), F.lit("all")
    for g in BREAKDOWNS:
        which = F.when(F.col(f"_by_{g}"), g).otherwise(which)
        value = F.when(F.col(f"_by_{g}"), F.col(g).cast("string")).otherwise(value)
    small = (which != "overall") & (F.col("_rows") < MIN_GROUP_ROWS)
    reason = F.concat(F.lit("n="), F.col("_rows").cast("string"), F.lit(f" < minimum {MIN_GROUP_ROWS}"))
    named = grouped.select(
        *keys, which.alias("breakdown"), value.alias("value"),
        F.when(small, F.col("_rows")).otherwise(F.col("n")).alias("n"), *[F.when(~small, F.col(k)).alias(k) for k in columns if k != "n"],
        F.when(small, reason).alias("excluded_reason"),
    )
    return named.where(F.col("value").isNotNull())


def comparison_table(metrics: DataFrame) -> DataFrame:
    """One row per model with its validation and test metrics side by side."""
    whole = metrics.where(F.col("breakdown") == "overall")
    names = ["mae", "rmse", "r2", "cv_rmse_pct"]
    wide = [
        F.max(F.when(F.col("split") == split, F.col(m))).alias(f"{split}_{m}") for split in ("validation", "test") for m in names
    ]
    return whole.groupBy("model_name").agg(*wide)


def select_model(comparison: DataFrame, baselines: list[str]) -> DataFrame:
    """The model with the lowest validation RMSE that beats every baseline; empty if none does."""
    bar = comparison.where(F.col("model_name").isin(baselines)).agg(F.min("validation_rmse")).scalar()
    candidates = comparison.where(~F.col("model_name").isin(baselines)).where(F.col("validation_rmse") < bar)
    best = Window.orderBy("validation_rmse", "model_name")  # one row per model
    return candidates.withColumn("_place", F.row_number().over(best)).where(F.col("_place") == 1).select("model_name", "validation_rmse")
