"""Look-ups, joins, aggregates and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulegrid.catalog.registry import query, r
from joulegrid.catalog.standins import EXPECTED_SQL, PERIODS, Tables, define, with_tables
from joulegrid.functions import calendar as cal
from joulegrid.operators import aggregates as ag, joins, lookups

MEASURES = ["air_temp_c", "cloud_coverage", "dew_temp_c", "wind_speed"]
_WEEK = ("2024-01-08", "2024-01-14")
_WEEK_SQL = "ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-14 23:59:59'"

# --- shared oracle tables -----------------------------------------------------------

define(
    "comparison", ("energy", "sensors", "buildings"),
    """SELECT b.building_id, b.site_id, b.primary_use, b.area_sqm, x.mean_kwh, x.median_kwh, x.total_kwh, x.peak_kwh, x.std_kwh,
      x.std_kwh / nullif(x.mean_kwh, 0) AS cv
    FROM (SELECT sensor_id, CAST(sum(consumption_kwh) AS DOUBLE) / count(consumption_kwh) AS mean_kwh,
            median(CAST(consumption_kwh AS DOUBLE)) AS median_kwh, CAST(sum(consumption_kwh) AS DOUBLE) AS total_kwh,
            CAST(max(consumption_kwh) AS DOUBLE) AS peak_kwh, stddev_samp(CAST(consumption_kwh AS DOUBLE)) AS std_kwh
          FROM energy GROUP BY 1) x
    JOIN sensors s ON s.sensor_id = x.sensor_id JOIN buildings b ON b.building_id = s.building_id""",
)
define(
    "site_joined", ("energy", "resolved", "weather"),
    """SELECT t.site_id, t.ts, t.site_kwh, w.air_temp_c, w.cloud_coverage, w.dew_temp_c, w.wind_speed
    FROM (SELECT r.site_id, e.ts, CAST(sum(e.consumption_kwh) AS DOUBLE) AS site_kwh
          FROM energy e JOIN resolved r ON r.sensor_id = e.sensor_id GROUP BY 1, 2) t
    JOIN weather w ON w.site_id = t.site_id AND w.ts = t.ts""",
)
define(
    "local_days", ("localised",),
    "SELECT date_trunc('day', lts) AS day, CAST(sum(consumption_kwh) AS DOUBLE) AS total_kwh FROM localised GROUP BY 1",
)


def comparison(t: Tables):
    return ag.building_comparison(t.energy(), t.sensors(), t.buildings())


def _pearson_sql(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    a, b = f"CASE WHEN {both} THEN CAST({x} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({y} AS DOUBLE) END"
    return (
        f"CASE WHEN count({a}) >= 2 AND min({a}) < max({a}) AND min({b}) < max({b}) "
        f"THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"
    )


# --- listings and look-ups ----------------------------------------------------------

@query("site_list", with_tables("SELECT *, (SELECT count(*) FROM sites) AS total FROM sites ORDER BY site_id LIMIT 50 OFFSET 5", "sites"))
def _(t):
    return lookups.list_sites(t.sites(), 50, 5)


_BUILDING = "building_id, building_code, site_id, primary_use, " + ", ".join(r(c, c) for c in ("area_sqm", "number_of_floors", "occupants", "year_built"))


def _as_doubles(buildings):
    """Optional whole numbers as doubles, so NULLs look the same on both sides."""
    return buildings.withColumns({c: F.col(c).cast("double") for c in ("number_of_floors", "occupants", "year_built")})


@query("building_list", with_tables(
    f"""SELECT {_BUILDING}, (SELECT count(*) FROM buildings WHERE primary_use = 'MACHINERY') AS total
    FROM buildings WHERE primary_use = 'MACHINERY' ORDER BY building_id LIMIT 50""", "buildings"))
def _(t):
    return _as_doubles(lookups.list_buildings(t.buildings(), primary_use="MACHINERY"))


@query("sensor_list", with_tables("SELECT *, (SELECT count(*) FROM sensors) AS total FROM sensors ORDER BY sensor_id LIMIT 200", "sensors"))
def _(t):
    return lookups.list_sensors(t.sensors(), limit=200)


@query("sites_by_key", with_tables(
    "SELECT * FROM sites WHERE site_id IN (SELECT user_id // 10 FROM events)", "sites"))
def _(t):
    keys = t.events().select(F.floor(F.col("user_id") / 10).cast("long").alias("site_id"))
    return lookups.by_keys(t.sites(), keys, "site_id")


@query("buildings_by_key", with_tables(
    f"""SELECT {_BUILDING} FROM buildings WHERE building_id IN (SELECT user_id FROM events)""", "buildings"))
def _(t):
    return lookups.by_keys(_as_doubles(t.buildings()), t.events().select(F.col("user_id").alias("building_id")), "building_id")


@query("sensors_by_key", with_tables("SELECT * FROM sensors WHERE sensor_id IN (SELECT sensor_id FROM energy)", "sensors", "energy"))
def _(t):
    return lookups.by_keys(t.sensors(), t.energy(), "sensor_id")


@query("electricity_sensors", with_tables("SELECT * FROM resolved", "resolved"))
def _(t):
    return t.resolved()


@query("readings_in_range", with_tables(
    f"SELECT sensor_id, ts, {r('consumption_kwh', 'consumption_kwh')} FROM energy WHERE {_WEEK_SQL}", "energy"))
def _(t):
    return t.energy().where(lookups.in_range(F.col("ts"), *_WEEK))


@query("readings_series", with_tables(
    f"""SELECT sensor_id, ts, {r('consumption_kwh', 'consumption_kwh')} FROM energy WHERE {_WEEK_SQL}
    QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY ts) <= 100""", "energy"))
def _(t):
    return lookups.series(t.energy(), "sensor_id", "ts", start=_WEEK[0], end=_WEEK[1], limit=100)


@query("weather_series", with_tables(
    f"""SELECT site_id, ts, {", ".join(r(m, m) for m in MEASURES)} FROM weather WHERE {_WEEK_SQL}
    QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY ts) <= 1000""", "weather"))
def _(t):
    return lookups.series(t.weather(), "site_id", "ts", start=_WEEK[0], end=_WEEK[1])


@query("prediction_series", with_tables(
    f"""SELECT sensor_id, target_ts, model_name, model_version, generated_at, horizon, {r('predicted_kwh', 'predicted_kwh')}
    FROM predictions WHERE {_WEEK_SQL.replace('ts ', 'target_ts ', 1)}
    QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY target_ts) <= 100""", "predictions"))
def _(t):
    return lookups.series(t.predictions(), "sensor_id", "target_ts", start=_WEEK[0], end=_WEEK[1], limit=100)


@query("readings_of_sensors", with_tables(
    f"""SELECT sensor_id, ts, {r('consumption_kwh', 'consumption_kwh')} FROM energy
    WHERE sensor_id IN (SELECT s.sensor_id FROM sensors s JOIN buildings b ON b.building_id = s.building_id WHERE b.primary_use = 'BUILDING')""",
    "energy", "sensors", "buildings"))
def _(t):
    offices = t.sensors().join(t.buildings().where(F.col("primary_use") == "BUILDING"), "building_id")
    return lookups.by_keys(t.energy(), offices, "sensor_id")


define(
    "predictions_168", ("dense",),
    """SELECT a.sensor_id, a.ts AS target_ts, 'seasonal_naive_168h' AS model_name, 'v1' AS model_version,
      a.ts - to_hours(CASE WHEN hour(a.ts) = 0 THEN 24 ELSE hour(a.ts) END) AS generated_at,
      CAST(CASE WHEN hour(a.ts) = 0 THEN 24 ELSE hour(a.ts) END AS INTEGER) AS horizon, b.consumption_kwh AS predicted_kwh
    FROM dense a JOIN dense b ON b.sensor_id = a.sensor_id AND b.ts = a.ts - INTERVAL 168 HOUR""",
)


@query("predictions_of_model", with_tables(
    f"""SELECT sensor_id, target_ts, model_name, model_version, generated_at, horizon, {r('predicted_kwh', 'predicted_kwh')}
    FROM (SELECT * FROM predictions UNION ALL SELECT * FROM predictions_168) WHERE model_name = 'seasonal_naive_168h' AND model_version = 'v1'""",
    "predictions", "predictions_168"))
def _(t):
    both = t.predictions().unionByName(t.predictions(168))
    return lookups.matching(both, model_name="seasonal_naive_168h", model_version="v1")


@query("readings_by_split", with_tables(
    "SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-25' THEN 'validation' ELSE 'test' END AS split, "
    f"count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, {r('sum(consumption_kwh)', 'total_kwh')} FROM energy GROUP BY 1", "energy"))
def _(t):
    parts = lookups.split_periods(t.energy(), "ts", PERIODS)
    named = [rows.select(F.lit(name).alias("split"), "ts", "consumption_kwh") for name, rows in parts.items()]
    merged = named[0].unionByName(named[1]).unionByName(named[2])
    return merged.groupBy("split").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("consumption_kwh").alias("total_kwh")
    )


@query("midnight_origins", with_tables(
    f"SELECT sensor_id, ts, timezone, {r('consumption_kwh', 'consumption_kwh')} FROM localised WHERE hour(lts) = 0", "localised"))
def _(t):
    zones = t.resolved().select("sensor_id", "timezone")
    return lookups.local_midnight(t.energy().join(zones, "sensor_id"), "ts", "timezone")


@query("latest_origins", with_tables(
    f"""SELECT sensor_id, target_ts, generated_at, horizon, {r('predicted_kwh', 'predicted_kwh')} FROM predictions
    QUALIFY generated_at = max(generated_at) OVER (PARTITION BY sensor_id)""", "predictions"))
def _(t):
    rows = t.predictions().drop("model_name", "model_version")
    return lookups.latest_origin(rows, origin="generated_at")


@query("origins_in_range", with_tables(
    f"""SELECT sensor_id, target_ts, generated_at, horizon, {r('predicted_kwh', 'predicted_kwh')} FROM predictions
    WHERE generated_at >= TIMESTAMP '2024-01-20' AND generated_at < TIMESTAMP '2024-01-25'""", "predictions"))
def _(t):
    return t.predictions().drop("model_name", "model_version").where(lookups.in_period(F.col("generated_at"), *PERIODS["validation"]))


@query("complete_forecast", with_tables(
    f"""SELECT p.sensor_id, p.generated_at, p.target_ts, p.horizon, {r('p.predicted_kwh', 'predicted_kwh')}, p.model_name, p.model_version
    FROM predictions p JOIN (SELECT sensor_id, generated_at FROM predictions GROUP BY 1, 2 HAVING count(DISTINCT horizon) = 24
      ORDER BY 1, 2 LIMIT 1) k ON k.sensor_id = p.sensor_id AND k.generated_at = p.generated_at""", "predictions"))
def _(t):
    return lookups.complete_forecast(t.predictions())


# --- joins --------------------------------------------------------------------------

@query("readings_with_dimensions", with_tables(
    f"""SELECT e.sensor_id, e.ts, {r('e.consumption_kwh', 'consumption_kwh')}, s.building_id, b.site_id, b.primary_use, {r('b.area_sqm', 'area_sqm')}, t.timezone AS tz
    FROM energy e LEFT JOIN sensors s ON s.sensor_id = e.sensor_id LEFT JOIN buildings b ON b.building_id = s.building_id
    LEFT JOIN sites t ON t.site_id = b.site_id""", "energy", "sensors", "buildings", "sites"))
def _(t):
    return joins.with_dimensions(t.energy(), t.sensors(), t.buildings(), t.sites())


@query("matched_facts", """SELECT b.site_id, o.o_orderkey FROM orders o
    JOIN (SELECT c_custkey, c_custkey // 10 AS site_id FROM customer) b ON b.c_custkey = CASE WHEN o.o_orderkey % 5 = 0 THEN -o.o_custkey ELSE o.o_custkey END""")
def _(t):
    code = F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))  # every fifth code is unknown
    facts = t.raw("orders").select(code.alias("code"), "o_orderkey")
    known = t.customers().select(F.col("c_custkey").alias("code"), F.floor(F.col("c_custkey") / 10).cast("long").alias("site_id"))
    return joins.drop_unmatched(facts, known, "code", "site_id")


@query("site_weather", with_tables(
    f"SELECT site_id, ts, {r('site_kwh', 'site_kwh')}, {', '.join(r(m, m) for m in MEASURES)} FROM site_joined", "site_joined"))
def _(t):
    return joins.site_weather(t.energy(), t.resolved(), t.weather())


@query("seasonal_naive_24h", with_tables(
    f"""SELECT a.sensor_id, a.ts AS target_ts, {r('b.consumption_kwh', 'predicted_kwh')}
    FROM energy a LEFT JOIN energy b ON b.sensor_id = a.sensor_id AND b.ts = a.ts - INTERVAL 24 HOUR""", "energy"))
def _(t):
    return joins.seasonal_naive(t.energy().select("sensor_id", F.col("ts").alias("target_ts")), t.energy(), 24)


@query("seasonal_naive_168h", with_tables(
    f"""SELECT a.sensor_id, a.ts AS target_ts, {r('b.consumption_kwh', 'predicted_kwh')}
    FROM energy a LEFT JOIN energy b ON b.sensor_id = a.sensor_id AND b.ts = a.ts - INTERVAL 168 HOUR""", "energy"))
def _(t):
    return joins.seasonal_naive(t.energy().select("sensor_id", F.col("ts").alias("target_ts")), t.energy(), 168)


@query("predictions_with_actuals", with_tables(
    f"""SELECT p.sensor_id, p.target_ts, p.horizon, {r('p.predicted_kwh', 'predicted_kwh')}, {r('e.consumption_kwh', 'actual_kwh')}
    FROM predictions p JOIN energy e ON e.sensor_id = p.sensor_id AND e.ts = p.target_ts WHERE e.consumption_kwh IS NOT NULL""", "predictions", "energy"))
def _(t):
    return joins.with_actuals(t.predictions(), t.energy(), keep_missing=False).select("sensor_id", "target_ts", "horizon", "predicted_kwh", "actual_kwh")


define(
    "forecast_view", ("predictions", "energy"),
    """SELECT p.*, CAST(e.consumption_kwh AS DOUBLE) AS actual_kwh, CAST(e.consumption_kwh AS DOUBLE) - CAST(p.predicted_kwh AS DOUBLE) AS residual
    FROM predictions p LEFT JOIN energy e ON e.sensor_id = p.sensor_id AND e.ts = p.target_ts""",
)


@query("forecast_view", with_tables(
    f"SELECT sensor_id, target_ts, horizon, {r('predicted_kwh', 'predicted_kwh')}, {r('actual_kwh', 'actual_kwh')}, {r('residual', 'residual')} FROM forecast_view",
    "forecast_view"))
def _(t):
    view = joins.with_actuals(t.predictions(), t.energy(), keep_missing=True)
    return view.select("sensor_id", "target_ts", "horizon", "predicted_kwh", "actual_kwh", "residual")


@query("overlay_readings", with_tables(
    f"""SELECT d.sensor_id, d.ts, {r('coalesce(t.injected_value, d.consumption_kwh)', 'consumption_kwh')}
    FROM dense d LEFT JOIN truth t ON t.sensor_id = d.sensor_id AND t.ts = d.ts""", "dense", "truth"))
def _(t):
    return joins.overlay(t.dense(), t.truth())


# --- summaries ----------------------------------------------------------------------

_SUMMARY = """count(*) AS row_count, count(consumption_kwh) AS observations,
      {mean}, {median}, {low}, {high}, {std}, {total}, min(ts) AS first_ts, max(ts) AS last_ts, {cv}""".format(
    mean=r("CAST(sum(consumption_kwh) AS DOUBLE) / count(consumption_kwh)", "mean_kwh"),
    median=r("median(CAST(consumption_kwh AS DOUBLE))", "median_kwh"),
    low=r("min(consumption_kwh)", "min_kwh"), high=r("max(consumption_kwh)", "max_kwh"),
    std=r("stddev_samp(CAST(consumption_kwh AS DOUBLE))", "std_kwh"), total=r("sum(consumption_kwh)", "total_kwh"),
    cv=r("stddev_samp(CAST(consumption_kwh AS DOUBLE)) / nullif(CAST(sum(consumption_kwh) AS DOUBLE) / count(consumption_kwh), 0)", "cv"),
)


@query("sensor_summary", with_tables(
    f"SELECT sensor_id, {_SUMMARY}, greatest({EXPECTED_SQL} - count(consumption_kwh), 0) AS missing_hours FROM energy GROUP BY 1", "energy"))
def _(t):
    return ag.missing_hours(ag.sensor_summary(t.energy()), t.expected_hours())


def _bucket_sql(unit: str, source: str = "energy") -> str:
    return with_tables(
        f"""SELECT sensor_id, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS bucket,
          {r('CAST(sum(consumption_kwh) AS DOUBLE) / count(consumption_kwh)', 'mean_kwh')}, {r('sum(consumption_kwh)', 'total_kwh')},
          {r('min(consumption_kwh)', 'min_kwh')}, {r('max(consumption_kwh)', 'max_kwh')},
          {r('stddev_samp(CAST(consumption_kwh AS DOUBLE))', 'std_kwh')}, count(consumption_kwh) AS observations
        FROM {source} GROUP BY 1, 2""", source)


for _name, _unit in cal.GRANULARITIES.items():
    query(f"time_buckets_{_name}", _bucket_sql(_unit))(lambda t, g=_name: ag.time_buckets(t.energy(), g))

query("weekly_buckets_from_rollup", _bucket_sql("week"))(lambda t: ag.buckets_from_rollup(ag.daily_rollup(t.energy()), "weekly"))


@query("daily_rollup", with_tables(
    f"""SELECT sensor_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS row_count, count(consumption_kwh) AS observations,
      {r('sum(consumption_kwh)', 'sum_kwh')}, {r('sum(CAST(consumption_kwh AS DOUBLE) * CAST(consumption_kwh AS DOUBLE))', 'sum_sq_kwh')},
      {r('min(consumption_kwh)', 'min_kwh')}, {r('max(consumption_kwh)', 'max_kwh')} FROM energy GROUP BY 1, 2""", "energy"))
def _(t):
    return ag.daily_rollup(t.energy())


_PARTS = {"hour": "CAST(hour(lts) AS INTEGER)", "day_of_week": "CAST(dayofweek(lts) AS INTEGER)", "month": "CAST(month(lts) AS INTEGER)", "is_weekend": "dayofweek(lts) IN (0, 6)"}
_PROFILE = f"{r('CAST(sum(consumption_kwh) AS DOUBLE) / count(consumption_kwh)', 'mean_kwh')}, {r('sum(consumption_kwh)', 'total_kwh')}, count(consumption_kwh) AS observations"

for _part, _expr in _PARTS.items():
    query(f"profile_{_part}", with_tables(f"SELECT sensor_id, {_expr} AS {_part}, {_PROFILE} FROM localised GROUP BY 1, 2", "localised"))(
        lambda t, p=_part: ag.profile(t.energy(), t.resolved(), p)
    )
for _part in ("hour", "day_of_week"):
    query(f"dataset_profile_{_part}", with_tables(f"SELECT {_PARTS[_part]} AS {_part}, {_PROFILE} FROM localised GROUP BY 1", "localised"))(
        lambda t, p=_part: ag.profile(t.energy(), t.resolved(), p, per_sensor=False)
    )


@query("profile_bundle", with_tables(
    " UNION ALL ".join(
        f"SELECT sensor_id, '{part}' AS profile, CAST({_PARTS[part]} AS VARCHAR) AS value, "
        f"{r('CAST(sum(consumption_kwh) AS DOUBLE) / count(consumption_kwh)', 'mean_kwh')}, count(consumption_kwh) AS observations "
        f"FROM localised GROUP BY sensor_id, {_PARTS[part]}" for part in _PARTS
    ), "localised"))
def _(t):
    return ag.profile_bundle(t.energy(), t.resolved())


@query("dataset_overview", with_tables(
    """SELECT (SELECT count(*) FROM sites) AS sites, (SELECT count(*) FROM buildings) AS buildings, (SELECT count(*) FROM weather) AS weather_rows,
      count(*) AS readings, min(ts) AS first_ts, max(ts) AS last_ts FROM energy""", "sites", "buildings", "weather", "energy"))
def _(t):
    return ag.overview(t.sites(), t.buildings(), t.weather(), t.energy())


@query("local_day_totals", with_tables(f"SELECT CAST(day AS TIMESTAMP) AS day, {r('total_kwh', 'total_kwh')} FROM local_days", "local_days"))
def _(t):
    return ag.local_day_totals(t.energy(), t.resolved())


@query("month_totals", with_tables(
    f"SELECT CAST(date_trunc('month', day) AS TIMESTAMP) AS month, {r('sum(total_kwh)', 'total_kwh')} FROM local_days GROUP BY 1", "local_days"))
def _(t):
    return ag.month_totals(ag.local_day_totals(t.energy(), t.resolved()))


_COMPARED = "building_id, site_id, primary_use, " + ", ".join(
    r(c, c) for c in ("area_sqm", "mean_kwh", "median_kwh", "total_kwh", "peak_kwh", "std_kwh", "cv")
)


@query("building_comparison", with_tables(f"SELECT {_COMPARED} FROM comparison", "comparison"))
def _(t):
    return comparison(t)


@query("building_comparison_of_use", with_tables(f"SELECT {_COMPARED} FROM comparison WHERE primary_use = 'HOUSEHOLD'", "comparison"))
def _(t):
    return ag.building_comparison(t.energy(), t.sensors(), t.buildings(), primary_use="HOUSEHOLD")


@query("energy_intensity", with_tables(
    f"""SELECT b.building_id, {r('m.total / b.area', 'total_per_sqm')}, {r('m.total / m.days / b.area', 'daily_per_sqm')}, {r('m.total / m.months / b.area', 'monthly_per_sqm')}
    FROM (SELECT sensor_id, CAST(sum(consumption_kwh) AS DOUBLE) AS total, count(DISTINCT date_trunc('day', ts)) AS days,
            count(DISTINCT date_trunc('month', ts)) AS months FROM energy WHERE consumption_kwh IS NOT NULL GROUP BY 1) m
    JOIN sensors s ON s.sensor_id = m.sensor_id
    JOIN (SELECT building_id, CAST(area_sqm AS DOUBLE) AS area FROM buildings) b ON b.building_id = s.building_id""", "energy", "sensors", "buildings"))
def _(t):
    return ag.energy_intensity(t.energy(), t.sensors(), t.buildings())


_ATTRIBUTES = ["area_sqm", "number_of_floors", "occupants", "year_built"]


@query("attribute_correlations", with_tables(
    " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, {r(_pearson_sql('b.' + a, 'c.mean_kwh'), 'r')}, "
        f"count(CASE WHEN b.{a} IS NOT NULL AND c.mean_kwh IS NOT NULL THEN 1 END) AS n_pairs, count(b.{a}) AS populated "
        "FROM comparison c JOIN buildings b ON b.building_id = c.building_id" for a in _ATTRIBUTES
    ), "comparison", "buildings"))
def _(t):
    return ag.attribute_correlations(comparison(t), t.buildings(), _ATTRIBUTES)


@query("weather_correlations", with_tables(
    " UNION ALL ".join(
        f"SELECT site_id, '{m}' AS measure, {r(_pearson_sql(m, 'site_kwh'), 'r')}, "
        f"count(CASE WHEN {m} IS NOT NULL AND site_kwh IS NOT NULL THEN 1 END) AS n_pairs, count(*) AS n_hours FROM site_joined GROUP BY 1" for m in MEASURES
    ), "site_joined"))
def _(t):
    return ag.weather_correlations(joins.site_weather(t.energy(), t.resolved(), t.weather()), MEASURES)


@query("mean_by_use", with_tables(
    f"SELECT coalesce(primary_use, '(unspecified)') AS primary_use, {r('avg(mean_kwh)', 'mean_of_means')}, count(*) AS buildings FROM comparison GROUP BY 1", "comparison"))
def _(t):
    return ag.mean_by_use(comparison(t))


@query("portfolio_kpis", with_tables(
    f"SELECT count(*) AS buildings, {r('sum(coalesce(total_kwh, 0))', 'total_kwh')}, {r('avg(coalesce(mean_kwh, 0))', 'mean_of_means')} FROM comparison", "comparison"))
def _(t):
    return ag.portfolio_kpis(comparison(t))


def _histogram_sql(column: str, count: int, source: str) -> str:
    return with_tables(
        f"""SELECT CAST(least(coalesce(floor(({column} - lo) / nullif((hi - lo) / {count}, 0)) + 1, 1), {count}) AS INTEGER) AS bin, count(*) AS n
        FROM {source}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}) WHERE {column} IS NOT NULL GROUP BY 1""", source)


@query("peak_histogram", _histogram_sql("peak_kwh", 15, "comparison"))
def _(t):
    return ag.histogram(comparison(t), "peak_kwh", 15)


@query("residual_histogram", with_tables(
    """SELECT CAST(least(coalesce(floor((e - lo) / nullif((hi - lo) / 60, 0)) + 1, 1), 60) AS INTEGER) AS bin, count(*) AS n
    FROM (SELECT -residual AS e FROM forecast_view), (SELECT min(-residual) AS lo, max(-residual) AS hi FROM forecast_view) WHERE e IS NOT NULL GROUP BY 1""",
    "forecast_view"))
def _(t):
    view = joins.with_actuals(t.predictions(), t.energy(), keep_missing=True)
    return ag.histogram(view.select((-F.col("residual")).alias("error")), "error", 60)


# --- quality ------------------------------------------------------------------------

@query("reading_gaps", with_tables(
    f"""SELECT sensor_id, count(*) AS actual_rows, CAST({EXPECTED_SQL} AS BIGINT) AS expected_rows, {EXPECTED_SQL} - count(*) AS missing_timestamps,
      count(*) FILTER (consumption_kwh IS NULL) AS null_rows, round_even(count(*) FILTER (consumption_kwh IS NULL) / count(*), 4) AS null_rate
    FROM energy GROUP BY 1""", "energy"))
def _(t):
    return ag.reading_gaps(t.energy(), t.expected_hours())


@query("duplicate_keys", "SELECT count(*) AS duplicate_keys FROM (SELECT user_id, date_trunc('hour', ts) FROM events GROUP BY 1, 2 HAVING count(*) > 1)")
def _(t):
    return ag.duplicate_keys(t.events().select("user_id", F.date_trunc("hour", "ts").alias("hour")), ["user_id", "hour"])


@query("weather_null_rates", with_tables(
    " UNION ALL ".join(
        f"SELECT count(*) AS total_rows, '{m}' AS column_name, round_even(count(*) FILTER ({m} IS NULL) / count(*), 4) AS null_rate FROM weather" for m in MEASURES
    ), "weather"))
def _(t):
    return ag.null_rates(t.weather(), MEASURES)


@query("missing_ranking", with_tables(
    f"""SELECT b.building_id, b.building_code, {r(f'greatest({EXPECTED_SQL} - n, 0) / {EXPECTED_SQL}::DOUBLE', 'missing_rate')}
    FROM (SELECT sensor_id, count(consumption_kwh) AS n FROM energy GROUP BY 1) e JOIN sensors s ON s.sensor_id = e.sensor_id
    JOIN buildings b ON b.building_id = s.building_id""", "energy", "sensors", "buildings"))
def _(t):
    return ag.missing_ranking(t.energy(), t.sensors(), t.buildings(), t.expected_hours())


def _candidates(t: Tables):
    return ag.missing_ranking(t.energy(), t.sensors(), t.buildings(), t.expected_hours()).join(
        t.buildings().select("building_id", "site_id"), "building_id"
    ).where(F.col("missing_rate") < 0.05)


define(
    "candidates", ("energy", "sensors", "buildings"),
    f"""SELECT b.building_id, b.site_id, greatest({EXPECTED_SQL} - n, 0) / {EXPECTED_SQL}::DOUBLE AS missing_rate
    FROM (SELECT sensor_id, count(consumption_kwh) AS n FROM energy GROUP BY 1) e JOIN sensors s ON s.sensor_id = e.sensor_id
    JOIN buildings b ON b.building_id = s.building_id WHERE greatest({EXPECTED_SQL} - n, 0) / {EXPECTED_SQL}::DOUBLE < 0.05""",
)


@query("site_missing_stats", with_tables(
    f"SELECT site_id, count(*) AS buildings, {r('avg(missing_rate)', 'mean_missing')} FROM candidates GROUP BY 1", "candidates"))
def _(t):
    return ag.site_missing_stats(_candidates(t))


@query("building_selection", with_tables(
    f"""SELECT c.building_id, c.site_id, {r('c.missing_rate', 'missing_rate')}
    FROM candidates c JOIN (
      SELECT site_id, rk, coalesce(sum(n) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT site_id, count(*) AS n, row_number() OVER (ORDER BY count(*), avg(missing_rate), site_id) AS rk FROM candidates GROUP BY 1)
    ) s ON s.site_id = c.site_id WHERE s.rk <= 8 AND s.before < 60
    QUALIFY row_number() OVER (PARTITION BY c.site_id ORDER BY c.missing_rate, c.building_id) <= 60 - any_value(s.before) OVER (PARTITION BY c.site_id)""", "candidates"))
def _(t):
    return ag.select_buildings(_candidates(t), max_sites=8)


# --- ranking ------------------------------------------------------------------------

@query("top_peaks", with_tables(
    f"""SELECT sensor_id, ts, {r('consumption_kwh', 'consumption_kwh')}, CAST(rk AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY consumption_kwh DESC, ts) AS rk FROM energy WHERE consumption_kwh IS NOT NULL) WHERE rk <= 10""", "energy"))
def _(t):
    return lookups.top_peaks(t.energy(), 10)



@query("peak_per_month", with_tables(
    f"""SELECT sensor_id, CAST(month(lts) AS INTEGER) AS month, ts AS peak_ts, {r('consumption_kwh', 'peak_kwh')} FROM localised WHERE consumption_kwh IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY sensor_id, month(lts) ORDER BY consumption_kwh DESC, ts) = 1""", "localised"))
def _(t):
    return ag.peak_per_month(t.energy(), t.resolved())


@query("top_buildings_by_mean", with_tables(
    f"SELECT building_id, {r('mean_kwh', 'mean_kwh')} FROM comparison ORDER BY comparison.mean_kwh DESC, building_id LIMIT 20", "comparison"))
def _(t):
    return lookups.top_rows(comparison(t), "mean_kwh", "building_id", 20).select("building_id", "mean_kwh")


@query("top_buildings_by_total", with_tables(
    f"SELECT building_id, {r('total_kwh', 'total_kwh')} FROM comparison ORDER BY coalesce(comparison.total_kwh, 0) DESC, building_id LIMIT 12", "comparison"))
def _(t):
    return lookups.top_rows(comparison(t), "total_kwh", "building_id", 12).select("building_id", "total_kwh")


# --- forecast statistics ------------------------------------------------------------

@query("forecast_screen", with_tables(
    f"""SELECT model_name, model_version, count(*) AS predictions, {r('avg(abs(residual))', 'mean_abs_residual')}, min(horizon) AS min_horizon, max(horizon) AS max_horizon
    FROM forecast_view GROUP BY 1, 2""", "forecast_view"))
def _(t):
    return ag.forecast_screen(joins.with_actuals(t.predictions(), t.energy(), keep_missing=True))


@query("forecast_order", with_tables(
    "SELECT count(*) AS total_rows, count(*) FILTER (generated_at < target_ts) AS ordered_rows FROM predictions", "predictions"))
def _(t):
    return ag.forecast_order(t.predictions())


# --- scalar functions ---------------------------------------------------------------

@query("calendar_features", with_tables(
    f"""SELECT sensor_id, ts, CAST(hour(lts) AS INTEGER) AS hour, CAST(dayofweek(lts) AS INTEGER) AS day_of_week, CAST(day(lts) AS INTEGER) AS day_of_month,
      CAST(month(lts) AS INTEGER) AS month, dayofweek(lts) IN (0, 6) AS is_weekend,
      {r('sin(2 * pi() * hour(lts) / 24)', 'hour_sin')}, {r('cos(2 * pi() * hour(lts) / 24)', 'hour_cos')},
      {r('sin(2 * pi() * dayofweek(lts) / 7)', 'dow_sin')}, {r('cos(2 * pi() * dayofweek(lts) / 7)', 'dow_cos')},
      {r('sin(2 * pi() * (month(lts) - 1) / 12)', 'month_sin')}, {r('cos(2 * pi() * (month(lts) - 1) / 12)', 'month_cos')} FROM localised""", "localised"))
def _(t):
    zones = t.resolved().select("sensor_id", "timezone")
    local = cal.local(F.col("ts"), F.col("timezone"))
    return t.energy().join(zones, "sensor_id").select("sensor_id", "ts", *cal.calendar_columns(local))


@query("scatter_temperature_load", with_tables(
    f"SELECT site_id, ts, {r('air_temp_c', 'air_temp_c')}, {r('site_kwh', 'site_kwh')} FROM site_joined WHERE air_temp_c IS NOT NULL AND site_kwh IS NOT NULL", "site_joined"))
def _(t):
    joined = joins.site_weather(t.energy(), t.resolved(), t.weather())
    return joined.select("site_id", "ts", "air_temp_c", "site_kwh").dropna()


@query("scatter_actual_predicted", with_tables(
    f"SELECT sensor_id, target_ts, {r('actual_kwh', 'actual_kwh')}, {r('predicted_kwh', 'predicted_kwh')} FROM forecast_view WHERE actual_kwh IS NOT NULL AND predicted_kwh IS NOT NULL", "forecast_view"))
def _(t):
    return joins.with_actuals(t.predictions(), t.energy(), keep_missing=False).select("sensor_id", "target_ts", "actual_kwh", "predicted_kwh")
