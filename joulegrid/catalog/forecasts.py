"""Series operators, the feature table, forecasts and their metrics."""

from __future__ import annotations


from joulegrid.catalog.registry import query, r
from joulegrid.catalog.standins import PERIODS, WIDE_COLUMNS, Tables, define, with_tables
from joulegrid.forecasting import features as feat, jobs, metrics
from joulegrid.operators import aggregates as ag, joins, series as ser

_ROW = "PARTITION BY sensor_id ORDER BY ts"
_X = "CAST(consumption_kwh AS DOUBLE)"


def _rolling_sql(function: str, n: int) -> str:
    frame = f"({_ROW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({_X}) OVER {frame} = {n} THEN {function}({_X}) OVER {frame} END"


for _source in ("energy", "dense"):
    define(
        f"grid_{_source}", (_source,),
        f"""SELECT g.sensor_id, g.ts, e.consumption_kwh
        FROM (SELECT sensor_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM {_source} GROUP BY 1) g
        LEFT JOIN {_source} e ON e.sensor_id = g.sensor_id AND e.ts = g.ts""",
    )
    define(
        f"hourly_features_{_source}", (f"grid_{_source}",),
        "SELECT sensor_id, ts, consumption_kwh, "
        + ", ".join(f"lag({_X}, {k - 1}) OVER ({_ROW}) AS lag_{k}" for k in ser.LAGS)
        + f", {_rolling_sql('avg', 24)} AS rolling_24h_mean, {_rolling_sql('stddev_samp', 24)} AS rolling_24h_std, {_rolling_sql('avg', 168)} AS rolling_168h_mean"
        + ", [" + ", ".join(f"lead({_X}, {h}) OVER ({_ROW})" for h in ser.HORIZONS) + "] AS targets"
        + f" FROM grid_{_source}",
    )
    define(
        f"features_{_source}", (f"hourly_features_{_source}", "resolved", "buildings"),
        f"""SELECT *, (target_ts AT TIME ZONE 'UTC') AT TIME ZONE tz AS target_local FROM (
          SELECT f.sensor_id, f.ts AS origin_ts, {', '.join('f.' + c for c in feat.LAG_COLUMNS + feat.ROLLING_COLUMNS)},
            r.building_id, r.site_id, r.timezone AS tz, CAST(b.area_sqm AS DOUBLE) AS area_sqm, b.primary_use,
            CAST(unnest(range(1, 25)) AS INTEGER) AS horizon, unnest(f.targets) AS target_kwh, f.ts + to_hours(CAST(unnest(range(1, 25)) AS INTEGER)) AS target_ts
          FROM hourly_features_{_source} f JOIN resolved r ON r.sensor_id = f.sensor_id JOIN buildings b ON b.building_id = r.building_id
          WHERE hour((f.ts AT TIME ZONE 'UTC') AT TIME ZONE r.timezone) = 0)""",
    )

_FEATURE_NUMBERS = feat.LAG_COLUMNS + feat.ROLLING_COLUMNS
_READY = " AND ".join(f"{c} IS NOT NULL" for c in [*_FEATURE_NUMBERS, "area_sqm", "primary_use"])
_SPLIT = """CASE WHEN origin_ts >= TIMESTAMP '2024-01-01' AND origin_ts < TIMESTAMP '2024-01-20' THEN 'train'
  WHEN origin_ts >= TIMESTAMP '2024-01-20' AND origin_ts < TIMESTAMP '2024-01-25' THEN 'validation'
  WHEN origin_ts >= TIMESTAMP '2024-01-25' AND origin_ts < TIMESTAMP '2024-02-01' THEN 'test' END"""


def static(t: Tables):
    return feat.static_features(t.buildings(), t.sensors(), t.sites())


# --- series -------------------------------------------------------------------------

@query("hourly_grid", with_tables(f"SELECT sensor_id, ts, {r('consumption_kwh', 'consumption_kwh')} FROM grid_energy", "grid_energy"))
def _(t):
    return ser.hourly_grid(t.energy())


@query("lag_features", with_tables(
    f"SELECT sensor_id, ts, {', '.join(r(c, c) for c in feat.LAG_COLUMNS)} FROM hourly_features_energy", "hourly_features_energy"))
def _(t):
    return ser.own_rows(ser.add_lags(ser.chunked_grid(t.energy(), feat.LOOKBACK_HOURS, 0)), *feat.LAG_COLUMNS)


@query("rolling_features", with_tables(
    f"SELECT sensor_id, ts, {', '.join(r(c, c) for c in feat.ROLLING_COLUMNS)} FROM hourly_features_energy", "hourly_features_energy"))
def _(t):
    return ser.own_rows(ser.add_rolling(ser.chunked_grid(t.energy(), feat.LOOKBACK_HOURS, 0)), *feat.ROLLING_COLUMNS)


@query("horizon_targets", with_tables(
    "SELECT sensor_id, ts, " + ", ".join(r(f"targets[{h}]", f"target_h{h}") for h in ser.HORIZONS) + " FROM hourly_features_energy", "hourly_features_energy"))
def _(t):
    return ser.own_rows(ser.add_targets(ser.chunked_grid(t.energy(), 0, 24)), *[f"target_h{h}" for h in ser.HORIZONS])


@query("unpivoted_readings", with_tables(
    " UNION ALL ".join(f"SELECT user_id, ts, '{c}' AS building_code, {r(chr(34) + c + chr(34), 'consumption_kwh')} FROM wide" for c in WIDE_COLUMNS), "wide"))
def _(t):
    return ser.unpivot_readings(t.wide(), ["user_id", "ts"], WIDE_COLUMNS)


# --- feature table ------------------------------------------------------------------

_FEATURE_SQL = f"""sensor_id, origin_ts, building_id, site_id, tz, primary_use, horizon, target_ts, {r('target_kwh', 'target_kwh')},
  {', '.join(r(c, c) for c in [*_FEATURE_NUMBERS, 'area_sqm'])},
  CAST(hour(target_local) AS INTEGER) AS hour, CAST(dayofweek(target_local) AS INTEGER) AS day_of_week,
  CAST(day(target_local) AS INTEGER) AS day_of_month, CAST(month(target_local) AS INTEGER) AS month, dayofweek(target_local) IN (0, 6) AS is_weekend"""
_FEATURE_OUT = [
    "sensor_id", "origin_ts", "building_id", "site_id", "tz", "primary_use", "horizon", "target_ts", "target_kwh",
    *_FEATURE_NUMBERS, "area_sqm", "hour", "day_of_week", "day_of_month", "month", "is_weekend",
]


@query("feature_table", with_tables(f"SELECT {_FEATURE_SQL} FROM features_energy", "features_energy"))
def _(t):
    return feat.feature_table(t.energy(), static(t)).select(*_FEATURE_OUT)


@query("training_rows", with_tables(
    f"SELECT {_FEATURE_SQL}, {_SPLIT} AS split FROM features_dense WHERE {_READY} AND target_kwh IS NOT NULL AND {_SPLIT} IS NOT NULL", "features_dense"))
def _(t):
    return feat.training_rows(feat.feature_table(t.dense(), static(t)), PERIODS).select(*_FEATURE_OUT, "split")


@query("split_retention", with_tables(
    f"""SELECT split, count(*) AS rows_before, count(*) FILTER ({_READY} AND target_kwh IS NOT NULL) AS rows_after
    FROM (SELECT *, {_SPLIT} AS split FROM features_dense) WHERE split IS NOT NULL GROUP BY 1""", "features_dense"))
def _(t):
    return ag.retention(feat.with_split(feat.feature_table(t.dense(), static(t)), PERIODS), "split", feat.REQUIRED)


# --- forecasts ----------------------------------------------------------------------

_NAIVE_OUT = f"f.sensor_id, f.target_ts, 'seasonal_naive_24h' AS model_name, 'v1' AS model_version, f.origin_ts AS generated_at, f.horizon, {r('d.consumption_kwh', 'predicted_kwh')}"
_NAIVE_JOIN = "JOIN dense d ON d.sensor_id = f.sensor_id AND d.ts = f.target_ts - INTERVAL 24 HOUR WHERE d.consumption_kwh IS NOT NULL"


@query("latest_day_forecast", with_tables(
    f"""SELECT {_NAIVE_OUT} FROM (SELECT * FROM features_dense WHERE {_READY}
      QUALIFY origin_ts = max(origin_ts) OVER (PARTITION BY sensor_id)) f {_NAIVE_JOIN}""", "features_dense", "dense"))
def _(t):
    return jobs.predict_latest(feat.origins(t.dense(), static(t)), t.dense(), "seasonal_naive_24h")


@query("forecast_backfill", with_tables(
    f"""SELECT {_NAIVE_OUT} FROM (SELECT * FROM features_dense WHERE {_READY}
      AND origin_ts >= TIMESTAMP '2024-01-20' AND origin_ts < TIMESTAMP '2024-01-25') f {_NAIVE_JOIN}""", "features_dense", "dense"))
def _(t):
    return jobs.backfill(feat.origins(t.dense(), static(t)), t.dense(), "seasonal_naive_24h", *PERIODS["validation"])


# --- metrics ------------------------------------------------------------------------

define(
    "scored", ("predictions", "energy", "resolved", "buildings"),
    """SELECT p.horizon, r.building_id, r.site_id, b.primary_use, CAST(p.predicted_kwh AS DOUBLE) AS p, CAST(e.consumption_kwh AS DOUBLE) AS y
    FROM predictions p LEFT JOIN energy e ON e.sensor_id = p.sensor_id AND e.ts = p.target_ts
    JOIN resolved r ON r.sensor_id = p.sensor_id JOIN buildings b ON b.building_id = r.building_id""",
)


def scored(t: Tables):
    attributes = static(t).select("sensor_id", "building_id", "site_id", "primary_use")
    return joins.with_actuals(t.predictions(), t.energy(), keep_missing=True).join(attributes, "sensor_id")


def _metric_sql(group: str | None) -> str:
    pair = "y IS NOT NULL AND p IS NOT NULL"
    y, e = f"CASE WHEN {pair} THEN y END", f"CASE WHEN {pair} THEN y - p END"
    figures = {
        "mae": f"avg(abs({e}))",
        "rmse": f"sqrt(avg(({e}) * ({e})))",
        "r2": f"CASE WHEN count({y}) < 2 THEN NULL WHEN min({y}) = max({y}) THEN CASE WHEN sum(({e}) * ({e})) = 0 THEN 1 ELSE 0 END ELSE 1 - sum(({e}) * ({e})) / (var_pop({y}) * count({y})) END",
        "cv_rmse_pct": f"sqrt(avg(({e}) * ({e}))) / nullif(avg({y}), 0) * 100",
    }
    if group is None:
        return with_tables(f"SELECT count({y}) AS n, {', '.join(r(v, k) for k, v in figures.items())} FROM scored", "scored")
    columns = ", ".join(r(f"CASE WHEN count(*) >= 30 THEN {v} END", k) for k, v in figures.items())
    return with_tables(
        f"""SELECT {group}, CASE WHEN count(*) < 30 THEN count(*) ELSE count({y}) END AS n, {columns},
        CASE WHEN count(*) < 30 THEN 'n=' || count(*) || ' < minimum 30' END AS excluded_reason
        FROM scored WHERE {group} IS NOT NULL GROUP BY 1""", "scored")


@query("forecast_metrics", _metric_sql(None))
def _(t):
    return metrics.overall(scored(t), "actual_kwh", "predicted_kwh")


for _group in metrics.BREAKDOWNS:
    query(f"forecast_metrics_by_{_group}", _metric_sql(_group))(
        lambda t, g=_group: metrics.by_group(scored(t), "actual_kwh", "predicted_kwh", g)
    )


@query("building_error_histogram", with_tables(
    """SELECT CAST(least(coalesce(floor((v - lo) / nullif((hi - lo) / 20, 0)) + 1, 1), 20) AS INTEGER) AS bin, count(*) AS n
    FROM m, (SELECT min(v) AS lo, max(v) AS hi FROM m) WHERE v IS NOT NULL GROUP BY 1""".replace(
        "FROM m,", "FROM (SELECT sqrt(avg((y - p) * (y - p))) / nullif(avg(y), 0) * 100 AS v FROM scored WHERE y IS NOT NULL GROUP BY building_id),"
    ).replace("FROM m)", "FROM (SELECT sqrt(avg((y - p) * (y - p))) / nullif(avg(y), 0) * 100 AS v FROM scored WHERE y IS NOT NULL GROUP BY building_id))"), "scored"))
def _(t):
    return ag.histogram(metrics.by_group(scored(t), "actual_kwh", "predicted_kwh", "building_id"), "cv_rmse_pct", 20)


@query("error_by_horizon", with_tables(
    f"SELECT horizon, {r('avg(abs(y - p))', 'mae')}, {r('sqrt(avg((y - p) * (y - p)))', 'rmse')} FROM scored WHERE y IS NOT NULL GROUP BY 1", "scored"))
def _(t):
    return metrics.by_group(scored(t), "actual_kwh", "predicted_kwh", "horizon").select("horizon", "mae", "rmse")
