"""Reports on raw tables, argument and text parsing, and rows that state what fitted or hash-driven work must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from joulegrid.anomalies import inject
from joulegrid.catalog.registry import query, r
from joulegrid.catalog.standins import PERIODS, WIDE_COLUMNS, Tables, with_tables
from joulegrid.functions import text
from joulegrid.operators import lookups
from joulegrid.plans import inspection


def _measures(rows: DataFrame, prefix: str) -> DataFrame:
    """A one-row table as (measure, value) rows."""
    return rows.select(F.inline(F.array(*[
        F.struct(F.lit(f"{prefix}{c}").alias("measure"), F.col(c).cast("double").alias("value")) for c in rows.columns
    ])))


def _counted(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.select(F.concat(F.lit(prefix), F.col(column).cast("string")).alias("measure"), F.col("n").cast("double").alias("value"))


@query("metadata_profile", """
    SELECT 'rows' AS measure, CAST(count(*) AS DOUBLE) AS value FROM customer UNION ALL SELECT 'duplicate_ids', CAST(count(*) - count(DISTINCT c_custkey) AS DOUBLE) FROM customer
    UNION ALL SELECT 'site_' || CAST(c_custkey // 10 AS VARCHAR), CAST(count(*) AS DOUBLE) FROM customer GROUP BY c_custkey // 10
    UNION ALL SELECT 'electricity_' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'Yes' ELSE '<blank>' END, CAST(count(*) AS DOUBLE) FROM customer GROUP BY c_mktsegment = 'BUILDING'""")
def _(t: Tables):
    key = F.col("c_custkey")
    metadata = t.customers().select(
        key.cast("string").alias("building_id"), F.floor(key / 10).cast("long").cast("string").alias("site_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Yes").alias("electricity"),
    )
    found = inspection.metadata_profile(metadata)
    return _measures(found["summary"], "").unionByName(_counted(found["sites"], "site_id", "site_")).unionByName(_counted(found["electricity_flags"], "electricity", "electricity_"))


@query("weather_profile", with_tables(f"""
    SELECT 'rows' AS measure, CAST(count(*) AS DOUBLE) AS value FROM weather UNION ALL SELECT 'duplicate_rows', CAST(count(*) - count(DISTINCT (site_id, ts)) AS DOUBLE) FROM weather
    UNION ALL SELECT 'site_' || CAST(site_id AS VARCHAR), CAST(count(*) AS DOUBLE) FROM weather GROUP BY site_id
    UNION ALL SELECT 'first_ts', CAST(epoch(min(ts)) AS DOUBLE) FROM weather UNION ALL SELECT 'last_ts', CAST(epoch(max(ts)) AS DOUBLE) FROM weather""", "weather"))
def _(t):
    found = inspection.weather_profile(t.weather().withColumnsRenamed({"ts": "timestamp", "air_temp_c": "airTemperature"}))
    summary = found["summary"].withColumns({c: F.unix_timestamp(c) for c in ("first_ts", "last_ts")})
    return _measures(summary, "").unionByName(_counted(found["sites"], "site_id", "site_"))


_RATES = ", ".join(f"('{c}', (SELECT count(*) FILTER (\"{c}\" IS NULL) / count(*) FROM wide))" for c in WIDE_COLUMNS)


@query("missing_summary", with_tables(
    f"""SELECT count(*) AS buildings, {r('round_even(min(v), 4)', 'min_rate')}, {r('round_even(quantile_cont(v, 0.5), 4)', 'median_rate')}, {r('round_even(avg(v), 4)', 'mean_rate')}, {r('round_even(max(v), 4)', 'max_rate')},
    count(*) FILTER (v = 1.0) AS all_missing, count(*) FILTER (v < 0.05) AS under_5pct FROM (VALUES {_RATES}) x(k, v)""", "wide"))
def _(t):
    wide = t.wide().drop("user_id").withColumnRenamed("ts", "timestamp").withColumns({c: F.col(c).cast("double") for c in WIDE_COLUMNS})
    return inspection.readings_profile(wide)["missing_summary"]


@query("parsed_timestamps", """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 0 THEN CAST(o_orderdate AS DATE)::TIMESTAMP
      ELSE CAST(o_orderdate AS DATE)::TIMESTAMP + to_hours(CAST(o_orderkey % 24 AS INTEGER)) END AS local_ts FROM orders""")
def _(t):
    """Dates, two spellings of hours, words and blanks as submitted texts."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    hour = F.format_string("%02d:00:00", key % 24)
    kind = key % 5
    raw = F.when(kind == 0, day).when(kind == 1, F.concat(day, F.lit(" "), hour)).when(kind == 2, F.concat(F.lit(" "), day, F.lit("T"), hour)).when(kind == 3, "soon").otherwise(" ")
    return t.raw("orders").select("o_orderkey", text.to_wall_clock(raw).alias("local_ts"))


@query("readings_in_offset_range", with_tables(
    f"""SELECT sensor_id, ts, {r('consumption_kwh', 'consumption_kwh')} FROM energy WHERE ts BETWEEN TIMESTAMP '2024-01-04 22:00:00' AND TIMESTAMP '2024-01-08 17:00:00'""", "energy"))
def _(t):
    return t.energy().where(lookups.in_range(F.col("ts"), "2024-01-05T00:00:00+02:00", "2024-01-08T12:00:00-05:00"))


@query("injection_checks",
    """SELECT split, 0 AS repeated_slots, 0 AS outside_period, 0 AS changed_originals, 0 AS factor_outside, 0 AS overlong_spans, 0 AS unknown_types FROM (VALUES ('validation'), ('test')) s(split)""")
def _(t):
    """What every injected benchmark must keep, counted over all truth rows: each count of violations is zero."""
    dense = t.dense()
    kinds = {k: (short, long, low, high) for k, short, long, low, high in inject.TYPES}
    kind, ratio = F.col("anomaly_type"), F.col("injected_value").cast("double") / F.col("original_value").cast("double")
    outside = F.lit(False)
    for name, (_, _, low, high) in kinds.items():
        if low is not None:
            outside |= (kind == name) & ~ratio.between(low - 0.001, high + 0.001)
    outside |= (kind == "zero_consumption") & (F.col("injected_value") != 0)
    longest = F.coalesce(*[F.when(F.col("anomaly_type") == n, F.lit(v[1])) for n, v in kinds.items()])
    parts = []
    for split, seed in inject.SEEDS.items():
        truth = inject.injections(dense, *PERIODS[split], split, seed)
        slot = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(PERIODS[split][0]).cast("timestamp"))) / (3600 * inject.SLOT_HOURS))
        met = truth.join(dense.select("sensor_id", "ts", F.col("consumption_kwh").alias("_kwh")), ["sensor_id", "ts"], "left")
        spans = truth.groupBy("sensor_id", slot.alias("_slot"), "anomaly_type").agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > longest).alias("overlong_spans"))
        copies = truth.groupBy("sensor_id", "ts").count().agg(F.count_if(F.col("count") > 1).alias("repeated_slots"))
        parts.append(met.agg(
            F.count_if(~lookups.in_period(F.col("ts"), *PERIODS[split])).alias("outside_period"),
            F.count_if(~F.col("_kwh").eqNullSafe(F.col("original_value"))).alias("changed_originals"),
            F.count_if(outside).alias("factor_outside"), F.count_if(~kind.isin(list(kinds))).alias("unknown_types"),
        ).select(
            F.lit(split).alias("split"), copies.scalar().cast("int").alias("repeated_slots"), *[F.col(c).cast("int") for c in ("outside_period", "changed_originals", "factor_outside")],
            spans.scalar().cast("int").alias("overlong_spans"), F.col("unknown_types").cast("int"),
        ))
    return parts[0].unionByName(parts[1])
