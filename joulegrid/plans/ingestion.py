"""Ingestion job: raw files to dimension and fact tables, with an audit row per file."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from joulegrid import schema
from joulegrid.operators import aggregates as ag
from joulegrid.sources import cleaning, files, tables

MAX_MISSING_RATE = 0.05
_ALL = 2_000_000_000


def missing_rates(wide: DataFrame) -> DataFrame:
    """Share of missing hours of every building column, from one pass without unpivoting rows."""
    codes = files.building_codes(wide)
    shares = F.array(*[F.struct(F.lit(c).alias("building_id"), F.avg((F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`")).cast("double")).alias("missing_rate")) for c in codes])
    return wide.agg(shares.alias("_s")).select(F.inline("_s"))


def missing_rates_of(long: DataFrame) -> DataFrame:
    """Share of missing hours of every building of long rows."""
    value = F.col("consumption_kwh")
    return long.groupBy("building_id").agg(F.avg((value.isNull() | F.isnan(value)).cast("double")).alias("missing_rate"))


def candidates(metadata: DataFrame, rates: DataFrame) -> DataFrame:
    """Buildings with an electricity meter and few missing hours."""
    return (
        metadata.where(F.col("electricity") == "Yes")
        .join(rates, "building_id")
        .where(F.col("missing_rate") < MAX_MISSING_RATE)
        .select("building_id", "site_id", "missing_rate")
    )


def building_rows(metadata: DataFrame, selected: DataFrame, sites: DataFrame) -> DataFrame:
    """Metadata columns under model names; NaN becomes NULL and whole numbers are truncated."""
    def number(name: str):
        return F.when(~F.isnan(name), F.col(name))

    chosen = metadata.join(selected.select("building_id"), "building_id", "left_semi")
    return chosen.join(sites.select(F.col("site_code").alias("_site"), F.col("site_id").alias("_site_id")), F.col("site_id") == F.col("_site")).select(
        F.col("building_id").alias("building_code"), F.col("_site_id").alias("site_id"),
        F.col("primaryspaceusage").alias("primary_use"), number("sqm").alias("area_sqm"),
        F.col("sub_primaryspaceusage").alias("sub_primary_use"), number("lat").alias("latitude"), number("lng").alias("longitude"),
        number("yearbuilt").cast("int").alias("year_built"), number("numberoffloors").cast("int").alias("number_of_floors"),
        number("occupants").cast("int").alias("occupants"), "industry", "subindustry", F.col("heatingtype").alias("heating_type"),
        number("eui").alias("eui"), number("site_eui").alias("site_eui"), number("source_eui").alias("source_eui"),
        "leed_level", number("energystarscore").cast("int").alias("energy_star_rating"),
    )


def upsert_dimension(spark: SparkSession, path: str, incoming: DataFrame, ddl: str, code: str, key: str, update: list[str]) -> DataFrame:
    """Codes to ids, then the keyed upsert; only ``update`` columns change on known codes."""
    current = tables.read_or_none(spark, path)
    fields = schema.struct(ddl).fields
    if current is None:
        current = spark.createDataFrame([], schema.struct(ddl))
    given = set(incoming.columns)
    aligned = incoming.select(*[
        (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields if f.name != key
    ])
    numbered = tables.assign_ids(current, aligned, code, key, update)
    tables.upsert(spark, path, numbered, ddl, [key], update=[f.name for f in fields if f.name != key])
    return spark.read.parquet(path)


def _audited(spark: SparkSession, out: str, name: str, work: Callable[[], dict]) -> dict:
    """Run one file's load and record it, failed or not; a failure is raised again."""
    started = datetime.now(timezone.utc)
    try:
        result = work()
    except Exception as error:
        tables.append_audit(spark, f"{out}/ingestion_runs", [(name, started, datetime.now(timezone.utc), None, None, None, "failed", str(error))])
        raise
    tables.append_audit(spark, f"{out}/ingestion_runs", [(
        name, started, datetime.now(timezone.utc), result["read"], result["written"], result["read"] - result["written"],
        "success", json.dumps(result.get("stats", {}), sort_keys=True),
    )])
    return result


def run(
    spark: SparkSession, metadata_path: str, readings_path: str, weather_path: str, out: str,
    max_sites: int | None = None, max_buildings: int | None = None, min_buildings: int = 0,
) -> dict[str, dict]:
    """Load dimensions, readings and weather of every usable building, or of a selection when a limit is given.

    Safe to run again.
    """
    metadata = files.read_metadata(spark, metadata_path)
    columns = files.wide_columns(spark, readings_path)
    picked = candidates(metadata, missing_rates_of(files.read_long_readings(spark, readings_path, columns)))
    if max_sites is not None or max_buildings is not None:
        picked = ag.select_buildings(picked, max_sites or _ALL, max_buildings or _ALL)
    picked.write.mode("overwrite").parquet(f"{out}/selection")
    selected = ag.require_minimum(spark.read.parquet(f"{out}/selection"), min_buildings)

    def dimensions() -> dict:
        chosen = metadata.join(selected.select("building_id"), "building_id", "left_semi")
        zones = chosen.groupBy(F.col("site_id").alias("site_code")).agg(F.min("timezone").alias("timezone"))
        sites = upsert_dimension(spark, f"{out}/sites", zones, schema.SITES, "site_code", "site_id", ["timezone"])
        buildings = upsert_dimension(
            spark, f"{out}/buildings", building_rows(metadata, selected, sites), schema.BUILDINGS,
            "building_code", "building_id", ["primary_use", "area_sqm"],
        )
        meters = buildings.select("building_id", F.lit("electricity").alias("meter_type"), F.lit("kWh").alias("unit"))
        upsert_dimension(spark, f"{out}/sensors", meters, schema.SENSORS, "building_id", "sensor_id", ["unit"])
        count = selected.count()
        return {"read": count, "written": count}

    result = {"dimensions": _audited(spark, out, "metadata", dimensions)}
    sites, buildings, sensors = (spark.read.parquet(f"{out}/{n}") for n in ("sites", "buildings", "sensors"))

    def readings() -> dict:
        loaded = columns.join(selected.select("building_id"), "building_id", "left_semi")
        long = files.read_long_readings(spark, readings_path, loaded).withColumnRenamed("building_id", "building_code").withColumn(
            "consumption_kwh", F.when(~F.isnan("consumption_kwh"), F.col("consumption_kwh"))
        )
        zones = buildings.join(sites, "site_id").select("building_code", "timezone")
        clean, counters = cleaning.observed_readings(long, zones)
        meter_of = buildings.join(sensors, "building_id").select("building_code", "sensor_id")
        facts = clean.join(meter_of, "building_code").drop("building_code")
        counts = tables.upsert(spark, f"{out}/energy", facts, schema.ENERGY, schema.ENERGY_KEY, month_of="ts")
        return {**counts, "stats": counters()}

    def weather() -> dict:
        raw = files.read_weather(spark, weather_path)
        zones = sites.select(F.col("site_code").alias("site_id"), "timezone")
        clean = cleaning.clean_weather(raw, zones)
        facts = clean.join(sites.select("site_code", "site_id"), "site_code").drop("site_code")
        return tables.upsert(spark, f"{out}/weather", facts, schema.WEATHER, schema.WEATHER_KEY, month_of="ts")

    result["energy"] = _audited(spark, out, "readings", readings)
    result["weather"] = _audited(spark, out, "weather", weather)
    return result
