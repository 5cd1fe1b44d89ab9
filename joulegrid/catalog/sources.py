"""Ingestion rules, wall-clock conversion and submission checks on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from joulegrid.catalog.core import MEASURES
from joulegrid.catalog.registry import query, r
from joulegrid.catalog.standins import EXPECTED_SQL, WIDE_COLUMNS, Tables, define, with_tables
from joulegrid.functions import calendar as cal, text
from joulegrid.functions.zones import with_utc
from joulegrid.plans import ingestion, inspection
from joulegrid.plans.ingestion import missing_rates
from joulegrid.session import checkpoint_dir, written
from joulegrid.sources import cleaning, files

# Orders give wall clocks of many years: order date plus 0-3 h and 0 or 30 min, so spring and
# autumn changes of the sites' zones occur.

define(
    "wall", ("sites",),
    """SELECT o.o_orderkey AS ordinal, s.site_id AS code, s.timezone, o.o_orderdate + to_hours(CAST(o.o_orderkey % 4 AS INTEGER)) + to_minutes(CAST(30 * (o.o_orderkey % 2) AS INTEGER)) AS local_ts,
      CAST(CASE WHEN o.o_orderstatus = 'P' THEN -o.o_totalprice ELSE o.o_totalprice END / 100 AS DECIMAL(12,4)) AS consumption_kwh
    FROM orders o JOIN sites s ON s.site_id = o.o_custkey // 10""",
)
define(
    "placed", ("wall",),
    """SELECT *, CASE WHEN ambiguous THEN NULL WHEN back <> local_ts THEN date_trunc('hour', u AT TIME ZONE 'UTC') ELSE u AT TIME ZONE 'UTC' END AS ts FROM (
      SELECT *, u AT TIME ZONE timezone AS back,
        ((u + INTERVAL 1 HOUR) AT TIME ZONE timezone) = local_ts OR ((u - INTERVAL 1 HOUR) AT TIME ZONE timezone) = local_ts AS ambiguous
      FROM (SELECT *, local_ts AT TIME ZONE timezone AS u FROM wall))""",
)
define(
    "cleaned", ("placed",),
    """SELECT code, ts, CASE WHEN consumption_kwh >= 0 THEN consumption_kwh END AS consumption_kwh, consumption_kwh < 0 AS rejected, copies - 1 AS duplicates FROM (
      SELECT *, row_number() OVER (PARTITION BY code, ts ORDER BY local_ts, ordinal) AS place, count(*) OVER (PARTITION BY code, ts) AS copies FROM placed WHERE ts IS NOT NULL) WHERE place = 1""",
)


def _wall(t: Tables):
    key = F.col("o_orderkey")
    seconds = (key % 4) * 3600 + (key % 2) * 1800
    local = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + seconds).cast("timestamp_ntz")
    price = F.when(F.col("o_orderstatus") == "P", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")) / 100
    return t.raw("orders").select(
        key.alias("ordinal"), F.floor(F.col("o_custkey") / 10).cast("long").alias("code"), local.alias("local_ts"),
        price.cast("decimal(12,4)").alias("consumption_kwh"),
    )


def _zones(t: Tables):
    return t.sites().select(F.col("site_id").alias("code"), "timezone")


@query("wall_clock_to_utc", with_tables("SELECT ordinal, timezone, local_ts, ts, ambiguous FROM placed", "placed"))
def _(t):
    placed = with_utc(_wall(t).join(_zones(t), "code"), "local_ts", "timezone")
    return placed.select("ordinal", "timezone", "local_ts", "ts", F.col("ts_ambiguous").alias("ambiguous"))


@query("cleaned_readings", with_tables(f"SELECT code, ts, {r('consumption_kwh', 'consumption_kwh')} FROM cleaned", "cleaned"))
def _(t):
    return cleaning.clean_readings(_wall(t), _zones(t), "code")[0]


@query("cleaning_counters", with_tables(
    """SELECT (SELECT count(*) FROM placed) AS rows_in, (SELECT count(*) FROM placed WHERE ambiguous) AS ambiguous_dropped,
      CAST(sum(duplicates) AS BIGINT) AS duplicates_dropped, count(*) FILTER (rejected) AS negatives_rejected, count(*) AS rows_out FROM cleaned""", "placed", "cleaned"))
def _(t):
    return cleaning.clean_readings(_wall(t), _zones(t), "code")[1]


@query("column_missing_rates", with_tables(
    " UNION ALL ".join(f"SELECT '{c}' AS building_id, {r(f'count(*) FILTER ({chr(34)}{c}{chr(34)} IS NULL) / count(*)', 'missing_rate')} FROM wide" for c in WIDE_COLUMNS), "wide"))
def _(t):
    return missing_rates(t.wide().drop("user_id").withColumnRenamed("ts", "timestamp").withColumns({c: F.col(c).cast("double") for c in WIDE_COLUMNS}))


@query("code_cross_check", """SELECT count(m) AS metadata_ids, count(e) AS building_columns, count(*) FILTER (m AND e) AS in_both,
    count(*) FILTER (m AND e IS NULL) AS metadata_only, count(*) FILTER (e AND m IS NULL) AS columns_only, count(*) FILTER (flag) AS flagged,
    count(*) FILTER (flag AND e IS NULL) AS flagged_without_column, count(*) FILTER (e AND NOT coalesce(flag, false)) AS column_not_flagged
    FROM (SELECT CASE WHEN c_acctbal > 0 THEN c_name ELSE c_name || '*' END AS id, true AS m, c_mktsegment = 'BUILDING' AS flag FROM customer) a
    FULL OUTER JOIN (SELECT DISTINCT c_name AS id, true AS e FROM customer JOIN events ON user_id = c_custkey) b ON b.id = a.id""")
def _(t):
    name = F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("*")))  # some codes have no column
    metadata = t.customers().select(
        name.alias("building_id"), F.when(F.col("c_mktsegment") == "BUILDING", "Yes").alias("electricity")
    )
    codes = t.customers().join(t.events(), F.col("user_id") == F.col("c_custkey")).select(F.col("c_name").alias("building_id"))
    return inspection.cross_check(metadata, codes)


@query("text_checks", """SELECT doc_id, text IS NULL OR trim(text) = '' AS blank, coalesce(regexp_matches(text, '(?:Z|[+-]\\d{2}:?\\d{2})$'), false) AS has_offset,
    round(CAST(n_chars AS DOUBLE), 6) AS number FROM documents""")
def _(t):
    docs = t.raw("documents")
    return docs.select(
        "doc_id", text.is_blank(F.col("text")).alias("blank"), text.has_offset(F.col("text")).alias("has_offset"),
        text.to_number(F.col("n_chars").cast("string")).alias("number"),
    )


@query("quality_report", with_tables(
    f"""SELECT 'duplicate_readings' AS measure, CAST(count(*) AS DOUBLE) AS value FROM (SELECT 1 FROM energy GROUP BY sensor_id, ts HAVING count(*) > 1)
    UNION ALL SELECT 'duplicate_weather', CAST(count(*) AS DOUBLE) FROM (SELECT 1 FROM weather GROUP BY site_id, ts HAVING count(*) > 1)
    UNION ALL SELECT 'missing_timestamps', CAST(sum(m) AS DOUBLE) FROM (SELECT {EXPECTED_SQL} - count(*) AS m FROM energy GROUP BY sensor_id)
    UNION ALL SELECT 'null_rows', CAST(count(*) AS DOUBLE) FROM energy WHERE consumption_kwh IS NULL""", "energy", "weather"))
def _(t):
    report = inspection.quality_report(t.energy(), t.weather(), MEASURES, t.expected_hours())

    def one(name: str, rows, column):
        return rows.select(F.lit(name).alias("measure"), F.col(column).cast("double").alias("value"))

    gaps = report["gaps"]
    return (
        one("duplicate_readings", report["duplicate_readings"], "duplicate_keys")
        .unionByName(one("duplicate_weather", report["duplicate_weather"], "duplicate_keys"))
        .unionByName(one("missing_timestamps", gaps.agg(F.sum("missing_timestamps").alias("s")), "s"))
        .unionByName(one("null_rows", gaps.agg(F.sum("null_rows").alias("s")), "s"))
    )


# --- the ingestion job --------------------------------------------------------------------
# The readings with planted faults become the three raw files: a wide one of local hours, metadata and weather.
# One zone is half an hour off the others' hours and stays out of the wide file.

OFF_HOURS = "Asia/Kolkata"

define(
    "local_rows", ("defects", "resolved", "buildings"),
    f"""SELECT b.building_code, s.timezone, (d.ts AT TIME ZONE 'UTC') AT TIME ZONE s.timezone AS local_ts, d.consumption_kwh AS kwh
    FROM defects d JOIN resolved s ON s.sensor_id = d.sensor_id JOIN buildings b ON b.building_id = s.building_id WHERE s.timezone <> '{OFF_HOURS}'""",
)
define(
    "ingested", ("local_rows", "buildings"),
    """SELECT p.building_code, p.site_id, (h.local_ts AT TIME ZONE p.timezone) AT TIME ZONE 'UTC' AS ts, CASE WHEN l.kwh >= 0 THEN l.kwh END AS consumption_kwh, l.kwh < 0 AS rejected
    FROM (SELECT DISTINCT local_ts FROM local_rows) h
    CROSS JOIN (SELECT l.building_code, b.site_id, min(l.timezone) AS timezone FROM local_rows l JOIN buildings b ON b.building_code = l.building_code
      WHERE b.building_id % 7 <> 3 GROUP BY 1, 2 HAVING 1 - count(kwh) / (SELECT count(DISTINCT local_ts) FROM local_rows) < 0.05) p
    LEFT JOIN local_rows l ON l.building_code = p.building_code AND l.local_ts = h.local_ts""",
)


def _raw_files(t: Tables) -> dict[str, str]:
    out = f"{checkpoint_dir(t.spark).rstrip('/')}/{uuid.uuid4().hex}"
    zones = t.sites().select("site_id", "site_code", "timezone")
    places = t.buildings().join(zones, "site_id")
    metadata = places.select(
        F.col("building_code").alias("building_id"), F.col("site_code").alias("site_id"), "timezone", F.col("primary_use").alias("primaryspaceusage"),
        F.col("area_sqm").alias("sqm"), F.col("number_of_floors").alias("numberoffloors"), "occupants",
        F.when(F.col("building_id") % 7 == 3, "No").otherwise("Yes").alias("electricity"),
    )
    metadata.write.option("header", True).csv(f"{out}/metadata")
    meters = t.sensors().join(places.where(F.col("timezone") != OFF_HOURS).select("building_id", "building_code", "timezone"), "building_id")
    long = t.defects().join(meters, "sensor_id").select(
        "building_code", F.date_format(cal.local(F.col("ts"), F.col("timezone")), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "consumption_kwh"
    )
    files.write_wide_readings(written(long), f"{out}/readings")
    weather = t.weather().join(zones, "site_id").select(
        F.date_format(cal.local(F.col("ts"), F.col("timezone")), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("site_code").alias("site_id"),
        F.col("air_temp_c").alias("airTemperature"), F.col("dew_temp_c").alias("dewTemperature"), F.col("wind_speed").alias("windSpeed"),
    )
    weather.write.option("header", True).csv(f"{out}/weather")
    return {"files": out, "store": f"{out}/store"}


def _ingested_twice(t: Tables) -> str:
    at = _raw_files(t)
    for _ in range(2):
        ingestion.run(t.spark, f"{at['files']}/metadata", f"{at['files']}/readings", f"{at['files']}/weather", at["store"])
    return at["store"]


@query("ingested_energy", with_tables(f"SELECT building_code, ts, {r('consumption_kwh', 'consumption_kwh')} FROM ingested", "ingested"))
def _(t):
    """The store after the ingestion job ran twice over the same raw files."""
    store = _ingested_twice(t)
    read = t.spark.read.parquet
    codes = read(f"{store}/sensors").join(read(f"{store}/buildings"), "building_id").select("sensor_id", "building_code")
    return read(f"{store}/energy").join(codes, "sensor_id").select("building_code", "ts", "consumption_kwh")


@query("ingestion_audit", with_tables(
    """SELECT 'metadata' AS source_file, 2 AS runs, 'success' AS status, count(DISTINCT building_code) AS rows_read, CAST(0 AS BIGINT) AS negatives_rejected FROM ingested
    UNION ALL SELECT 'readings', 2, 'success', count(*), count(*) FILTER (rejected) FROM ingested
    UNION ALL SELECT 'weather', 2, 'success', count(*), 0 FROM weather WHERE site_id IN (SELECT site_id FROM ingested)""", "ingested", "weather"))
def _(t):
    """The audit rows of two equal runs: one per file and run, with the counters that the writing job gathered."""
    runs = t.spark.read.parquet(f"{_ingested_twice(t)}/ingestion_runs")
    rejected = F.coalesce(F.get_json_object("error_summary", "$.negatives_rejected").cast("long"), F.lit(0).cast("long"))
    return runs.groupBy("source_file", "status", F.col("rows_read"), rejected.alias("negatives_rejected")).agg(F.count("*").cast("int").alias("runs"))
