"""Reports on raw files and on stored tables, as small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from joulegrid import schema
from joulegrid.operators import aggregates as ag
from joulegrid.plans.ingestion import missing_rates

WEATHER_VALUES = [c.strip().split(" ")[0] for c in schema.WEATHER_CSV.split(",")][2:]


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("<blank>")).alias(column)).agg(F.count("*").alias("n"))


def column_presence(names: list[str], rows: DataFrame) -> DataFrame:
    """Which retained metadata columns a file's header has."""
    return rows.sparkSession.createDataFrame([(c, c in names) for c in schema.METADATA_COLUMNS], "column_name string, present boolean")


def metadata_profile(metadata: DataFrame) -> dict[str, DataFrame]:
    retained = [c for c in schema.METADATA_COLUMNS if c in metadata.columns]
    repeated = metadata.groupBy("building_id").agg(F.count("*").alias("_c"))
    return {
        "summary": repeated.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_ids")),
        "sites": value_counts(metadata, "site_id"),
        "electricity_flags": value_counts(metadata, "electricity"),
        "null_rates": ag.null_rates(metadata, retained),
    }


def weather_profile(weather: DataFrame) -> dict[str, DataFrame]:
    keyed = weather.groupBy("site_id", "timestamp").agg(F.count("*").alias("_c"))
    return {
        "summary": keyed.agg(
            F.sum("_c").alias("rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
            F.sum(F.col("_c") - 1).alias("duplicate_rows"),
        ),
        "sites": value_counts(weather, "site_id"),
        "null_rates": ag.null_rates(weather, [c for c in WEATHER_VALUES if c in weather.columns]),
    }


def readings_profile(wide: DataFrame) -> dict[str, DataFrame]:
    """Missing rates per building column and their distribution."""
    rates = missing_rates(wide)
    rate = F.col("missing_rate")
    repeated = wide.groupBy("timestamp").agg(F.count("*").alias("_c"))
    return {
        "summary": repeated.agg(
            F.sum("_c").alias("rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
            F.sum(F.col("_c") - 1).alias("duplicate_rows"),
        ),
        "missing_rates": rates,
        # one row per building column of the header, so the exact median is over a small list
        "missing_summary": rates.agg(
            F.count("*").alias("buildings"), F.bround(F.min(rate), 4).alias("min_rate"), F.bround(F.percentile(rate, 0.5), 4).alias("median_rate"),
            F.bround(F.avg(rate), 4).alias("mean_rate"), F.bround(F.max(rate), 4).alias("max_rate"),
            F.count_if(rate == 1.0).alias("all_missing"), F.count_if(rate < 0.05).alias("under_5pct"),
        ),
    }


def cross_check(metadata: DataFrame, codes: DataFrame) -> DataFrame:
    """Metadata ids against the building columns of the readings (``codes``: building_id)."""
    left = metadata.groupBy("building_id").agg(F.max(F.coalesce(F.col("electricity") == "Yes", F.lit(False))).alias("_flag")).withColumn("_m", F.lit(True))
    joined = left.join(codes.distinct().withColumn("_e", F.lit(True)), "building_id", "full_outer")
    m, e, flag = F.col("_m").isNotNull(), F.col("_e").isNotNull(), F.coalesce("_flag", F.lit(False))
    return joined.agg(
        F.count_if(m).alias("metadata_ids"), F.count_if(e).alias("building_columns"), F.count_if(m & e).alias("in_both"),
        F.count_if(m & ~e).alias("metadata_only"), F.count_if(e & ~m).alias("columns_only"), F.count_if(flag).alias("flagged"),
        F.count_if(flag & ~e).alias("flagged_without_column"), F.count_if(e & ~flag).alias("column_not_flagged"),
    )


def quality_report(readings: DataFrame, weather: DataFrame, measures: list[str], expected_hours: int) -> dict[str, DataFrame]:
    return {
        "gaps": ag.reading_gaps(readings, expected_hours),
        "duplicate_readings": ag.duplicate_keys(readings, schema.ENERGY_KEY),
        "duplicate_weather": ag.duplicate_keys(weather, schema.WEATHER_KEY),
        "weather_null_rates": ag.null_rates(weather, measures),
    }
