"""Cleaning of raw readings and weather."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window, functions as F

from joulegrid.functions.zones import with_utc


def reject_negative(readings: DataFrame) -> DataFrame:
    """Negative readings become NULL and are marked ``rejected``."""
    negative = F.coalesce(F.col("consumption_kwh") < 0, F.lit(False))
    return readings.withColumns(
        {"rejected": negative, "consumption_kwh": F.when(~negative, F.col("consumption_kwh"))}
    )


def first_of_duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in source order.

    A ranking with a limit: Spark cuts every partition to one row per key before the single exchange,
    so a key with very many copies shrinks first.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_source_order(rows: DataFrame) -> DataFrame:
    """Rows of a file scan with ``ordinal``: file name, place of the block in it, then row.

    Files follow their names; partition numbers alone would follow the packing of blocks by size.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    order = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), place.alias("row"))
    return rows.withColumn("ordinal", order)


def localised(rows: DataFrame, local: str = "local_ts", tz: str = "timezone") -> DataFrame:
    """Rows with a UTC ``ts``; ambiguous wall clocks are counted and dropped by the caller."""
    return with_utc(rows, local, tz, "ts")


def clean_readings(long: DataFrame, zones: DataFrame, code: str = "building_code") -> tuple[DataFrame, DataFrame]:
    """Long local readings -> (clean UTC readings, one row of counters).

    ``long`` has building_code, local_ts, ordinal, consumption_kwh; ``zones`` has the code
    and its timezone. The counters are aggregates of the same plan.
    """
    placed = localised(long.join(zones, code))
    usable = placed.where(F.col("ts").isNotNull()).select(code, "ts", "local_ts", "ordinal", "consumption_kwh")
    single = first_of_duplicates(usable, [code, "ts"], ["local_ts", "ordinal"])
    checked = reject_negative(single)
    clean = checked.select(code, "ts", F.col("consumption_kwh").cast("decimal(12,4)").alias("consumption_kwh"))
    ambiguous = placed.agg(
        F.count("*").alias("rows_in"), F.count_if("ts_ambiguous").alias("ambiguous_dropped"), F.count("ts").alias("usable")
    )
    counters = checked.agg(F.count("*").alias("rows_out"), F.count_if("rejected").alias("negatives_rejected")).select(
        ambiguous.select("rows_in").scalar().alias("rows_in"),
        ambiguous.select("ambiguous_dropped").scalar().alias("ambiguous_dropped"),
        (ambiguous.select("usable").scalar() - F.col("rows_out")).alias("duplicates_dropped"),
        "negatives_rejected", "rows_out",
    )
    return clean, counters


def observed_readings(long: DataFrame, zones: DataFrame, code: str = "building_code") -> tuple[DataFrame, Callable[[], dict]]:
    """(clean UTC readings, their counters): the counters are gathered by the job that writes the readings.

    The second part may be called once that job has ended.
    """
    before, after = Observation(), Observation()
    placed = localised(long.join(zones, code)).observe(
        before, F.count(F.lit(1)).alias("rows_in"), F.count_if("ts_ambiguous").alias("ambiguous_dropped"), F.count("ts").alias("usable")
    )
    usable = placed.where(F.col("ts").isNotNull()).select(code, "ts", "local_ts", "ordinal", "consumption_kwh")
    checked = reject_negative(first_of_duplicates(usable, [code, "ts"], ["local_ts", "ordinal"])).observe(
        after, F.count(F.lit(1)).alias("rows_out"), F.count_if("rejected").alias("negatives_rejected")
    )

    def counters() -> dict:
        seen = before.get | after.get
        seen["duplicates_dropped"] = seen.pop("usable") - seen["rows_out"]
        return seen

    return checked.select(code, "ts", F.col("consumption_kwh").cast("decimal(12,4)").alias("consumption_kwh")), counters


def clean_weather(raw: DataFrame, zones: DataFrame) -> DataFrame:
    """Source weather -> UTC rows per site, measures renamed and typed, first of duplicates."""
    from joulegrid.schema import WEATHER_MEASURES

    source = [
        "airTemperature", "cloudCoverage", "dewTemperature", "precipDepth1HR", "precipDepth6HR",
        "seaLvlPressure", "windDirection", "windSpeed",
    ]
    placed = localised(with_source_order(raw).withColumnRenamed("timestamp", "local_ts").join(zones, "site_id"))
    usable = placed.where(F.col("ts").isNotNull())
    single = first_of_duplicates(usable.select("site_id", "ts", "local_ts", "ordinal", *source), ["site_id", "ts"], ["local_ts", "ordinal"])
    measures = [
        F.when(~F.isnan(F.col(s)), F.col(s)).cast(ddl).alias(name) for s, (name, ddl) in zip(source, WEATHER_MEASURES.items())
    ]
    return single.select(F.col("site_id").alias("site_code"), "ts", *measures)
