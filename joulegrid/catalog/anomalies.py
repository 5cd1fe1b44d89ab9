"""Detectors, alerts and their evaluation, and keyed upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from joulegrid import schema
from joulegrid.anomalies import behavioural, evaluation, forest, inject, residual, rules
from joulegrid.catalog.forecasts import _X
from joulegrid.catalog.registry import ORACLES, query, r
from joulegrid.catalog.standins import PERIODS, Tables, define, with_tables
from joulegrid.operators import aggregates as ag, joins, lookups, series as ser
from joulegrid.session import checkpoint_dir, written
from joulegrid.sources import tables

_W = "(PARTITION BY sensor_id ORDER BY ts)"

# --- oracle tables of the detectors ---------------------------------------------------

define(
    "grid_defects", ("defects",),
    """SELECT g.sensor_id, g.ts, e.consumption_kwh
    FROM (SELECT sensor_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM defects GROUP BY 1) g
    LEFT JOIN defects e ON e.sensor_id = g.sensor_id AND e.ts = g.ts""",
)


def _rules_tables(source: str) -> None:
    around = ", ".join(f"lag(x, {k}) OVER {_W}" for k in (1, 2, 3)) + ", " + ", ".join(f"lead(x, {k}) OVER {_W}" for k in (1, 2, 3))
    define(
        f"rule_rows_{source}", (f"grid_{source}",),
        f"""SELECT *, count(*) OVER (PARTITION BY sensor_id, run) AS run_length,
          min(ts) OVER (PARTITION BY sensor_id, run) AS run_start, max(ts) OVER (PARTITION BY sensor_id, run) AS run_end,
          list_aggregate(list_filter(around, lambda v: v IS NOT NULL), 'median') AS neighbour_median
        FROM (SELECT *, sum(fresh) OVER {_W} AS run FROM (
          SELECT sensor_id, ts, x, lag(x) OVER {_W} AS left_kwh, lead(x) OVER {_W} AS right_kwh, [{around}] AS around,
            CASE WHEN row_number() OVER {_W} = 1 OR x IS DISTINCT FROM lag(x) OVER {_W} THEN 1 ELSE 0 END AS fresh
          FROM (SELECT sensor_id, ts, {_X} AS x FROM grid_{source})))""",
    )
    define(
        f"rule_candidates_{source}", (f"rule_rows_{source}",),
        f"""SELECT sensor_id, ts, 'negative_value' AS anomaly_type, 'high' AS severity, abs(x) AS score, CAST(0 AS DOUBLE) AS expected_value, x AS actual_value FROM rule_rows_{source} WHERE x < 0
        UNION ALL SELECT sensor_id, ts, 'missing', 'medium', 1.0, NULL, NULL FROM rule_rows_{source} WHERE x IS NULL
        UNION ALL SELECT sensor_id, ts, 'zero_run', 'medium', run_length, NULL, x FROM rule_rows_{source} WHERE x = 0 AND run_length >= 3
        UNION ALL SELECT sensor_id, ts, 'stuck_meter', 'medium', run_length, NULL, x FROM rule_rows_{source} WHERE x > 0 AND run_length >= 30
        UNION ALL SELECT sensor_id, ts, 'isolated_spike', CASE WHEN x / neighbour_median >= 8 THEN 'high' ELSE 'medium' END, x / neighbour_median, neighbour_median, x
          FROM rule_rows_{source} WHERE x >= 1 AND neighbour_median > 0 AND x >= 4 * neighbour_median AND left_kwh < 2.5 * neighbour_median AND right_kwh < 2.5 * neighbour_median""",
    )
    define(
        f"rule_alerts_{source}", (f"rule_candidates_{source}",),
        f"""SELECT *, 'data_quality' AS method, 'v1' AS detector_version FROM rule_candidates_{source}
        QUALIFY row_number() OVER (PARTITION BY sensor_id, ts ORDER BY score DESC, anomaly_type) = 1""",
    )


_rules_tables("defects")
_rules_tables("energy")

for _source in ("dense", "energy"):
    _same_hour = "(PARTITION BY sensor_id, hour(ts) ORDER BY ts ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"
    define(
        f"baseline_{_source}", (f"grid_{_source}",),
        f"""SELECT sensor_id, ts, x, med, mad, CASE WHEN mad * 1.4826 > 1e-6 THEN (x - med) / (mad * 1.4826) END AS z FROM (
          SELECT sensor_id, ts, x, CASE WHEN n = 14 THEN med END AS med, CASE WHEN n = 14 THEN mad END AS mad FROM (
            SELECT sensor_id, ts, x, count(x) OVER {_same_hour} AS n, quantile_cont(x, 0.5) OVER {_same_hour} AS med, mad(x) OVER {_same_hour} AS mad
            FROM (SELECT sensor_id, ts, {_X} AS x FROM grid_{_source})))""",
    )
define(
    "behavioural_alerts", ("baseline_dense",),
    """SELECT sensor_id, ts, 'behavioral_deviation' AS anomaly_type, CASE WHEN abs(z) >= 8 THEN 'high' ELSE 'medium' END AS severity, abs(z) AS score,
      med AS expected_value, x AS actual_value, 'behavioral' AS method, 'v1' AS detector_version FROM baseline_dense WHERE abs(z) >= 4""",
)
define(
    "alerts", ("rule_alerts_defects", "behavioural_alerts"),
    """SELECT *, CAST(NULL AS DOUBLE) AS residual, day(ts) % 5 = 0 AS resolved FROM (SELECT * FROM rule_alerts_defects UNION ALL SELECT * FROM behavioural_alerts)""",
)
_frame72 = "(PARTITION BY sensor_id ORDER BY target_ts ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)"
define(
    "residuals", ("predictions", "energy"),
    f"""SELECT *, CASE WHEN residual_std > 1e-6 THEN absolute_residual / residual_std END AS standardized_residual FROM (
      SELECT *, CASE WHEN count(absolute_residual) OVER {_frame72} = 72 THEN stddev_samp(absolute_residual) OVER {_frame72} END AS residual_std FROM (
        SELECT p.sensor_id, p.target_ts, CAST(p.predicted_kwh AS DOUBLE) AS predicted_kwh, CAST(e.consumption_kwh AS DOUBLE) AS actual_kwh,
          CAST(e.consumption_kwh AS DOUBLE) - CAST(p.predicted_kwh AS DOUBLE) AS absolute_residual,
          (CAST(e.consumption_kwh AS DOUBLE) - CAST(p.predicted_kwh AS DOUBLE)) / greatest(abs(CAST(e.consumption_kwh AS DOUBLE)), 0.1) AS relative_residual
        FROM predictions p JOIN energy e ON e.sensor_id = p.sensor_id AND e.ts = p.target_ts WHERE e.consumption_kwh IS NOT NULL))""",
)

_ALERT_SQL = f"sensor_id, ts, anomaly_type, severity, {r('score', 'score')}, {r('expected_value', 'expected_value')}, {r('actual_value', 'actual_value')}, method, detector_version"


def _plain(alerts):
    return alerts.drop("explanation", "residual", "resolved")


# --- detectors ----------------------------------------------------------------------

@query("quality_alerts", with_tables(f"SELECT {_ALERT_SQL} FROM rule_alerts_defects", "rule_alerts_defects"))
def _(t):
    return _plain(rules.detect(t.defects()))


@query("quality_alerts_with_gaps", with_tables(f"SELECT {_ALERT_SQL} FROM rule_alerts_energy", "rule_alerts_energy"))
def _(t):
    return _plain(rules.detect(t.energy()))


@query("equal_runs", with_tables(
    f"SELECT sensor_id, ts, {r('x', 'consumption_kwh')}, run_length, run_start, run_end FROM rule_rows_defects WHERE run_length >= 3 AND x >= 0", "rule_rows_defects"))
def _(t):
    runs = ser.equal_runs(ser.chunked_grid(t.defects(), 1, 0))
    return ser.own_rows(runs, "consumption_kwh", "run_length", "run_start", "run_end").where("run_length >= 3 AND consumption_kwh >= 0")


@query("isolated_spikes", with_tables(
    f"SELECT sensor_id, ts, {r('actual_value', 'consumption_kwh')}, {r('expected_value', 'neighbour_median')} FROM rule_candidates_energy WHERE anomaly_type = 'isolated_spike'", "rule_candidates_energy"))
def _(t):
    spikes = rules.add_spike_columns(ser.chunked_grid(t.energy(), rules.SPIKE_REACH, rules.SPIKE_REACH)).where("is_spike")
    return ser.own_rows(spikes, "consumption_kwh", "neighbour_median")


@query("non_negative_readings", with_tables(
    f"SELECT sensor_id, ts, {r('CASE WHEN consumption_kwh >= 0 THEN consumption_kwh END', 'consumption_kwh')}, coalesce(consumption_kwh < 0, false) AS rejected FROM defects", "defects"))
def _(t):
    from joulegrid.sources.cleaning import reject_negative

    return reject_negative(t.defects())


@query("behavioural_scores", with_tables(
    f"SELECT sensor_id, ts, {r('x', 'consumption_kwh')}, {r('med', 'baseline_median')}, {r('mad', 'baseline_mad')}, {r('z', 'z_score')} FROM baseline_energy", "baseline_energy"))
def _(t):
    return behavioural.scores(t.energy())


@query("behavioural_alerts", with_tables(f"SELECT {_ALERT_SQL} FROM behavioural_alerts", "behavioural_alerts"))
def _(t):
    return _plain(behavioural.detect(t.dense(), 4.0))


@query("residual_scores", with_tables(
    f"""SELECT sensor_id, target_ts, {', '.join(r(c, c) for c in ('predicted_kwh', 'actual_kwh', 'absolute_residual', 'relative_residual', 'residual_std', 'standardized_residual'))} FROM residuals""", "residuals"))
def _(t):
    scored = residual.residuals(joins.with_actuals(t.predictions(), t.energy(), keep_missing=False))
    return scored.select("sensor_id", "target_ts", "predicted_kwh", "actual_kwh", "absolute_residual", "relative_residual", "residual_std", "standardized_residual")


@query("residual_alerts", with_tables(
    f"""SELECT sensor_id, target_ts AS ts, CASE WHEN standardized_residual > 0 THEN 'high_residual' ELSE 'low_residual' END AS anomaly_type,
      CASE WHEN abs(standardized_residual) >= 8 THEN 'high' ELSE 'medium' END AS severity, {r('abs(standardized_residual)', 'score')},
      {r('predicted_kwh', 'expected_value')}, {r('actual_kwh', 'actual_value')}, {r('absolute_residual', 'residual')}, 'forecast_residual' AS method, 'v1' AS detector_version
    FROM residuals WHERE abs(standardized_residual) >= 4""", "residuals"))
def _(t):
    return residual.detect(t.predictions(), t.energy(), 4.0).drop("explanation")


define(
    "forest_inputs", ("hourly_features_energy", "baseline_energy"),
    f"""SELECT f.sensor_id, f.ts, CAST(f.consumption_kwh AS DOUBLE) AS consumption_kwh, f.lag_2 AS prev_hour_kwh, f.rolling_24h_mean, f.rolling_24h_std, f.rolling_168h_mean, b.z AS behavioral_z,
      sin(2 * pi() * hour(f.ts) / 24) AS hour_sin, cos(2 * pi() * hour(f.ts) / 24) AS hour_cos,
      sin(2 * pi() * (isodow(f.ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(f.ts) - 1) / 7) AS dow_cos
    FROM hourly_features_energy f JOIN baseline_energy b ON b.sensor_id = f.sensor_id AND b.ts = f.ts""",
)


@query("forest_inputs", with_tables(f"SELECT sensor_id, ts, {', '.join(r(c, c) for c in forest.FEATURES)} FROM forest_inputs", "forest_inputs"))
def _(t):
    return forest.features(t.energy())


@query("forest_complete_rows", with_tables(
    f"SELECT sensor_id, ts, {', '.join(r(c, c) for c in forest.FEATURES)} FROM forest_inputs WHERE {' AND '.join(c + ' IS NOT NULL' for c in forest.FEATURES)}", "forest_inputs"))
def _(t):
    return forest.complete(forest.features(t.energy()))


def _extreme_sql() -> str:
    names = forest.FEATURES
    complete = " AND ".join(f"{c} IS NOT NULL" for c in names)
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END" for c in names)
    return with_tables(
        f"""SELECT sensor_id, ts, CAST(list_position(sizes, list_max(sizes)) - 1 AS INTEGER) AS feature, {r('scaled[list_position(sizes, list_max(sizes))]', 'z')}
        FROM (SELECT sensor_id, ts, scaled, list_transform(scaled, lambda v: abs(v)) AS sizes FROM (
          SELECT sensor_id, ts, [{scaled}] AS scaled FROM forest_inputs WHERE {complete}))""", "forest_inputs")


@query("forest_extreme_feature", _extreme_sql())
def _(t):
    """Most extreme scaled input of every complete row."""
    rows = written(forest.complete(forest.features(t.energy())))
    worst = forest.with_scaled(rows, forest.scaling(rows)).withColumn("_w", forest.most_extreme())
    return worst.select("sensor_id", "ts", (-F.col("_w.order")).alias("feature"), F.col("_w.z").alias("z"))


def _forest_scores(t):
    rows = written(forest.complete(forest.features(t.dense())))
    train = rows.where(lookups.in_period(F.col("ts"), *PERIODS["train"]))
    scales = forest.scaling(train)
    nodes = forest.fit(forest.with_scaled(train, scales))
    return forest.score(forest.with_scaled(rows, scales), nodes, forest.SAMPLE).select("sensor_id", "ts", "score")


@query("forest_scores")
def _(t):
    """Isolation scores by a forest fitted on the training period (rows only: random trees)."""
    return _forest_scores(t)


@query("forest_score_checks", with_tables(
    """SELECT f.sensor_id, count(*) AS scored, 0 AS outside FROM hourly_features_dense f JOIN baseline_dense b ON b.sensor_id = f.sensor_id AND b.ts = f.ts
    WHERE f.consumption_kwh IS NOT NULL AND f.lag_2 IS NOT NULL AND rolling_24h_mean IS NOT NULL AND rolling_24h_std IS NOT NULL AND rolling_168h_mean IS NOT NULL AND b.z IS NOT NULL
    GROUP BY 1""", "hourly_features_dense", "baseline_dense"))
def _(t):
    """What any forest must keep: one score between 0 and 1 for every complete hour."""
    score = F.col("score")
    return _forest_scores(t).groupBy("sensor_id").agg(F.countDistinct("ts").alias("scored"), F.count_if(~((score > 0) & (score < 1))).cast("int").alias("outside"))


@query("injected_benchmark")
def _(t):
    """Truth rows of both periods (rows only: hash-driven)."""
    dense = t.dense()
    parts = [inject.injections(dense, *PERIODS[s], s, seed) for s, seed in inject.SEEDS.items()]
    return parts[0].unionByName(parts[1])


# --- alerts -------------------------------------------------------------------------

@query("all_alerts", with_tables(f"SELECT {_ALERT_SQL}, resolved FROM alerts", "alerts"))
def _(t):
    return t.alerts().drop("explanation", "residual")


@query("best_alert_per_hour", with_tables(
    f"SELECT {_ALERT_SQL} FROM alerts QUALIFY row_number() OVER (PARTITION BY sensor_id, ts, method, detector_version ORDER BY score DESC, anomaly_type) = 1", "alerts"))
def _(t):
    return rules.top_alert(_plain(t.alerts()))


@query("alert_search", with_tables(
    f"""SELECT {_ALERT_SQL} FROM alerts WHERE method = 'data_quality' AND severity = 'medium' AND NOT resolved AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 23:59:59'""", "alerts"))
def _(t):
    return _plain(lookups.find_alerts(t.alerts(), method="data_quality", severity="medium", resolved=False, start="2024-01-05", end="2024-01-12"))


@query("alert_page", with_tables(
    "SELECT sensor_id, ts, method, anomaly_type, severity, resolved, (SELECT count(*) FROM alerts) AS total FROM alerts ORDER BY ts DESC, sensor_id, method LIMIT 50 OFFSET 50", "alerts"))
def _(t):
    rows = t.alerts().select("sensor_id", "ts", "method", "anomaly_type", "severity", "resolved")
    return lookups.alert_page(rows, 50, 50)


@query("alerts_by_key", with_tables(
    f"SELECT {_ALERT_SQL} FROM alerts WHERE sensor_id IN (SELECT sensor_id FROM truth) AND (sensor_id, ts) IN (SELECT (sensor_id, ts) FROM truth)", "alerts", "truth"))
def _(t):
    return lookups.by_keys(_plain(t.alerts()), t.truth(), "sensor_id", "ts")


@query("building_alerts", with_tables(
    f"SELECT x.*, s.building_id FROM (SELECT {_ALERT_SQL} FROM alerts) x JOIN resolved s ON s.sensor_id = x.sensor_id", "alerts", "resolved"))
def _(t):
    return lookups.building_alerts(_plain(t.alerts()), t.resolved())


for _hours in (12, 36):
    query(f"alert_context_{_hours}h", with_tables(
        f"""SELECT a.sensor_id, a.ts AS alert_ts, a.method, e.ts, {r('e.consumption_kwh', 'consumption_kwh')} FROM alerts a JOIN energy e ON e.sensor_id = a.sensor_id
          AND e.ts BETWEEN a.ts - INTERVAL {_hours} HOUR AND a.ts + INTERVAL {_hours} HOUR""", "alerts", "energy"))(
        lambda t, h=_hours: lookups.alert_context(t.alerts(), t.energy(), h)
    )


@query("highest_alert_per_type", with_tables(
    f"SELECT anomaly_type, sensor_id, ts, {r('score', 'score')} FROM alerts QUALIFY row_number() OVER (PARTITION BY anomaly_type ORDER BY score DESC, ts, sensor_id) = 1", "alerts"))
def _(t):
    return lookups.highest_alert(t.alerts())


@query("alert_summary", with_tables(
    """SELECT 'all' AS part, CAST(NULL AS VARCHAR) AS value, count(*) AS alerts, count(*) FILTER (NOT resolved) AS unresolved FROM alerts
    UNION ALL SELECT 'method', method, count(*), count(*) FILTER (NOT resolved) FROM alerts GROUP BY 2
    UNION ALL SELECT 'anomaly_type', anomaly_type, count(*), count(*) FILTER (NOT resolved) FROM alerts GROUP BY 2
    UNION ALL SELECT 'severity', severity, count(*), count(*) FILTER (NOT resolved) FROM alerts GROUP BY 2""", "alerts"))
def _(t):
    return ag.alert_summary(t.alerts())


@query("alerts_by_severity", with_tables(
    "SELECT method, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium FROM alerts GROUP BY 1", "alerts"))
def _(t):
    return ag.alert_pivot(t.alerts(), F.col("method"), "severity", ["high", "medium"])


@query("alerts_by_month_and_method", with_tables(
    "SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) FILTER (method = 'data_quality') AS data_quality, count(*) FILTER (method = 'behavioral') AS behavioral FROM alerts GROUP BY 1", "alerts"))
def _(t):
    return ag.alert_pivot(t.alerts(), F.date_trunc("month", "ts").alias("month"), "method", ["data_quality", "behavioral"])


@query("alerts_per_month", with_tables(
    """SELECT CAST(m.month AS TIMESTAMP) AS month, count(a.ts) AS alerts FROM (SELECT unnest(generate_series(TIMESTAMP '2023-07-01', TIMESTAMP '2024-06-01', INTERVAL 1 MONTH)) AS month) m
    LEFT JOIN alerts a ON date_trunc('month', a.ts) = m.month GROUP BY 1""", "alerts"))
def _(t):
    return ag.alerts_per_month(t.alerts(), "2023-07-01", "2024-06-01")


@query("alerts_by_method", with_tables(
    "SELECT method, count(*) AS alerts FROM alerts GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM alerts", "alerts"))
def _(t):
    return ag.alerts_by_method(t.alerts())


# --- evaluation ---------------------------------------------------------------------

_KEYS = "SELECT DISTINCT sensor_id, ts FROM"


def _ratio_sql(source: str, extra: str = "") -> str:
    p, c = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END"
    return f"""SELECT {extra} tp, fp, fn, tn, {r(p, 'precision')}, {r(c, 'recall')},
      {r(f'CASE WHEN ({p}) + ({c}) = 0 THEN 0 ELSE 2 * ({p}) * ({c}) / (({p}) + ({c})) END', 'f1')},
      {r('CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END', 'false_positive_rate')}, {r('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')} FROM ({source})"""


@query("key_match", with_tables(
    f"""SELECT coalesce(t.sensor_id, p.sensor_id) AS sensor_id, coalesce(t.ts, p.ts) AS ts, t.ts IS NOT NULL AS in_truth, p.ts IS NOT NULL AS in_predicted
    FROM ({_KEYS} truth) t FULL OUTER JOIN ({_KEYS} alerts) p ON p.sensor_id = t.sensor_id AND p.ts = t.ts""", "truth", "alerts"))
def _(t):
    return joins.match_keys(t.truth(), t.alerts())


@query("key_intersection", with_tables("SELECT sensor_id, ts FROM truth INTERSECT SELECT sensor_id, ts FROM alerts", "truth", "alerts"))
def _(t):
    return t.truth().select("sensor_id", "ts").intersect(t.alerts().select("sensor_id", "ts"))


@query("key_difference", with_tables("SELECT sensor_id, ts FROM truth EXCEPT SELECT sensor_id, ts FROM alerts", "truth", "alerts"))
def _(t):
    return t.truth().select("sensor_id", "ts").subtract(t.alerts().select("sensor_id", "ts"))


@query("confusion", with_tables(
    _ratio_sql(f"""SELECT tp, fp, fn, (SELECT count(*) FROM dense) - tp - fp - fn AS tn FROM (
      SELECT count(*) FILTER (t.ts IS NOT NULL AND p.ts IS NOT NULL) AS tp, count(*) FILTER (t.ts IS NULL) AS fp, count(*) FILTER (p.ts IS NULL) AS fn
      FROM ({_KEYS} truth) t FULL OUTER JOIN ({_KEYS} alerts) p ON p.sensor_id = t.sensor_id AND p.ts = t.ts)"""), "truth", "alerts", "dense"))
def _(t):
    return evaluation.confusion(t.truth(), t.alerts(), t.dense())


@query("confusion_by_method", with_tables(
    _ratio_sql("""SELECT m.method, count(h.ts) AS tp, count(a.ts) - count(h.ts) AS fp, (SELECT count(*) FROM truth) - count(h.ts) AS fn,
      (SELECT count(*) FROM dense) - count(a.ts) - ((SELECT count(*) FROM truth) - count(h.ts)) AS tn
    FROM (SELECT unnest(['data_quality', 'behavioral', 'isolation_forest']) AS method) m
    LEFT JOIN (SELECT DISTINCT method, sensor_id, ts FROM alerts) a ON a.method = m.method
    LEFT JOIN truth h ON h.sensor_id = a.sensor_id AND h.ts = a.ts GROUP BY 1""", "method,"), "truth", "alerts", "dense"))
def _(t):
    return evaluation.confusion_by_method(t.truth(), t.alerts(), t.dense(), ["data_quality", "behavioral", "isolation_forest"])


@query("recall_by_type", with_tables(
    f"""SELECT anomaly_type, count(*) AS n, count(p.ts) AS tp, {r('count(p.ts) / count(*)', 'recall')}
    FROM truth t LEFT JOIN ({_KEYS} alerts) p ON p.sensor_id = t.sensor_id AND p.ts = t.ts GROUP BY 1""", "truth", "alerts"))
def _(t):
    return evaluation.recall_by_type(t.truth(), t.alerts())


@query("recall_by_type_and_method", with_tables(
    f"""SELECT m.method, t.anomaly_type, count(*) AS n, count(a.ts) AS tp, {r('count(a.ts) / count(*)', 'recall')}
    FROM (SELECT unnest(['data_quality', 'behavioral', 'isolation_forest']) AS method) m CROSS JOIN truth t
    LEFT JOIN (SELECT DISTINCT method, sensor_id, ts FROM alerts) a ON a.method = m.method AND a.sensor_id = t.sensor_id AND a.ts = t.ts
    GROUP BY 1, 2""", "truth", "alerts"))
def _(t):
    return evaluation.recall_by_type(t.truth(), t.alerts(), ["data_quality", "behavioral", "isolation_forest"])


@query("class_balance", with_tables(
    """SELECT s AS observation_slots, n AS injected_anomalies, s - n AS normal_slots, round_even(n * 100.0::DOUBLE / s, 4) AS anomaly_rate_pct, k AS affected_sensors
    FROM (SELECT (SELECT count(*) FROM dense) AS s, count(*) AS n, count(DISTINCT sensor_id) AS k FROM truth)""", "dense", "truth"))
def _(t):
    return evaluation.class_balance(t.dense(), t.truth())


@query("injected_by_type", with_tables("SELECT anomaly_type, count(*) AS n FROM truth GROUP BY 1", "truth"))
def _(t):
    return evaluation.counts_by_type(t.truth())


define(
    "swept", ("baseline_dense", "truth", "dense"),
    """SELECT g.threshold, count(h.ts) AS tp, count(b.ts) - count(h.ts) AS fp, (SELECT count(*) FROM truth) - count(h.ts) AS fn,
      (SELECT count(*) FROM dense) - count(b.ts) - ((SELECT count(*) FROM truth) - count(h.ts)) AS tn
    FROM (SELECT unnest([1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 7.5, 8])::DOUBLE AS threshold) g
    LEFT JOIN baseline_dense b ON abs(b.z) >= g.threshold LEFT JOIN truth h ON h.sensor_id = b.sensor_id AND h.ts = b.ts GROUP BY 1""",
)


def _swept(t: Tables):
    scored = behavioural.scores(t.dense()).select("sensor_id", "ts", F.abs("z_score").alias("score"))
    return evaluation.sweep(scored, t.truth(), t.dense(), evaluation.Z_GRID)


@query("threshold_sweep", with_tables(_ratio_sql("SELECT * FROM swept", "threshold,"), "swept"))
def _(t):
    return _swept(t)


@query("best_threshold", with_tables(_ratio_sql("SELECT * FROM swept", "threshold,") + " ORDER BY coalesce(f1, 0) DESC, threshold LIMIT 1", "swept"))
def _(t):
    return evaluation.best_threshold(_swept(t))


# --- upserts ------------------------------------------------------------------------

@query("merged_energy", with_tables(
    f"""SELECT coalesce(c.sensor_id, i.sensor_id) AS sensor_id, coalesce(c.ts, i.ts) AS ts, {r('CASE WHEN i.ts IS NOT NULL THEN i.consumption_kwh ELSE c.consumption_kwh END', 'consumption_kwh')}
    FROM energy c FULL OUTER JOIN (SELECT sensor_id, ts, injected_value AS consumption_kwh FROM truth) i ON i.sensor_id = c.sensor_id AND i.ts = c.ts""", "energy", "truth"))
def _(t):
    incoming = t.truth().select("sensor_id", "ts", F.col("injected_value").alias("consumption_kwh"))
    return tables.merged(t.energy(), incoming, ["sensor_id", "ts"])


_WEATHER = ("air_temp_c", "dew_temp_c", "wind_speed")


@query("merged_weather", with_tables(
    f"""SELECT coalesce(c.site_id, i.site_id) AS site_id, coalesce(c.ts, i.ts) AS ts, {", ".join(r(f"CASE WHEN i.ts IS NOT NULL THEN i.{m} ELSE c.{m} END", m) for m in _WEATHER)},
      {r('CASE WHEN i.ts IS NOT NULL THEN i.cloud_coverage ELSE c.cloud_coverage END', 'cloud_coverage')}
    FROM weather c FULL OUTER JOIN (SELECT site_id, CASE WHEN day(ts) > 20 THEN ts + INTERVAL 60 DAY ELSE ts END AS ts, {", ".join(f"{m} + 1 AS {m}" for m in _WEATHER)},
      CAST(hour(ts) % 9 AS DECIMAL(4,2)) AS cloud_coverage FROM weather) i ON i.site_id = c.site_id AND i.ts = c.ts""", "weather"))
def _(t):
    """Every weather row comes again with new values, the late days under new hours."""
    moved = F.when(F.dayofmonth("ts") > 20, F.col("ts") + F.expr("interval 60 days")).otherwise(F.col("ts"))
    current = t.weather().select("site_id", "ts", *_WEATHER, "cloud_coverage")
    incoming = t.weather().select(
        "site_id", moved.alias("ts"), *[(F.col(m) + 1).alias(m) for m in _WEATHER], (F.hour("ts") % 9).cast("decimal(4,2)").alias("cloud_coverage")
    )
    return tables.merged(current, incoming, ["site_id", "ts"])


@query("merged_predictions", with_tables(
    f"""SELECT p.sensor_id, p.target_ts, p.model_name, p.model_version, CASE WHEN t.ts IS NOT NULL THEN p.generated_at - INTERVAL 1 HOUR ELSE p.generated_at END AS generated_at,
      p.horizon, {r('CASE WHEN t.ts IS NOT NULL THEN t.injected_value ELSE p.predicted_kwh END', 'predicted_kwh')}
    FROM predictions p LEFT JOIN truth t ON t.sensor_id = p.sensor_id AND t.ts = p.target_ts""", "predictions", "truth"))
def _(t):
    current = t.predictions()
    again = current.join(t.truth().select("sensor_id", F.col("ts").alias("target_ts"), "injected_value"), ["sensor_id", "target_ts"]).withColumns(
        {"generated_at": F.col("generated_at") - F.expr("interval 1 hour"), "predicted_kwh": F.col("injected_value")}
    ).drop("injected_value")
    return tables.merged(current, again, ["sensor_id", "target_ts", "model_name", "model_version"], ["generated_at", "predicted_kwh", "horizon"])


@query("merged_alerts", with_tables(
    f"""SELECT coalesce(c.sensor_id, i.sensor_id) AS sensor_id, coalesce(c.ts, i.ts) AS ts, coalesce(c.method, i.method) AS method, coalesce(c.detector_version, i.detector_version) AS detector_version,
      {r('coalesce(i.score, c.score)', 'score')}, coalesce(c.resolved, false) AS resolved
    FROM alerts c FULL OUTER JOIN (SELECT sensor_id, CASE WHEN day(ts) >= 10 THEN ts + INTERVAL 60 DAY ELSE ts END AS ts, method, detector_version, score + 1 AS score FROM alerts) i
      ON i.sensor_id = c.sensor_id AND i.ts = c.ts AND i.method = c.method AND i.detector_version = c.detector_version""", "alerts"))
def _(t):
    """Every alert comes again with a new score, those of later days under new hours."""
    key = ["sensor_id", "ts", "method", "detector_version"]
    moved = F.when(F.dayofmonth("ts") >= 10, F.col("ts") + F.expr("interval 60 days")).otherwise(F.col("ts"))
    current = t.alerts().select(*key, "score", "resolved")
    incoming = current.select("sensor_id", moved.alias("ts"), "method", "detector_version", (F.col("score") + 1).alias("score"))
    return tables.merged(current, incoming, key, defaults={"resolved": False})


# --- the same upserts through a store ----------------------------------------------------

def _stored(t: Tables, current, incoming, ddl: str, keys: list[str], month_of: str, **how):
    """``current``, then ``incoming`` twice, into a new table of month partitions; what stands there afterwards."""
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/{uuid.uuid4().hex}"
    tables.upsert(t.spark, path, current, ddl, keys, month_of=month_of)
    incoming = written(incoming)
    for _ in range(2):
        tables.upsert(t.spark, path, incoming, ddl, keys, month_of=month_of, **how)
    return t.spark.read.parquet(path).drop(tables.MONTH)


@query("upserted_energy", ORACLES["merged_energy"])
def _(t):
    incoming = t.truth().select("sensor_id", "ts", F.col("injected_value").alias("consumption_kwh"))
    return _stored(t, t.energy(), incoming, schema.ENERGY, schema.ENERGY_KEY, "ts")


@query("upserted_weather", ORACLES["merged_weather"])
def _(t):
    moved = F.when(F.dayofmonth("ts") > 20, F.col("ts") + F.expr("interval 60 days")).otherwise(F.col("ts"))
    incoming = t.weather().select(
        "site_id", moved.alias("ts"), *[(F.col(m) + 1).alias(m) for m in _WEATHER], (F.hour("ts") % 9).cast("decimal(4,2)").alias("cloud_coverage")
    )
    return _stored(t, t.weather(), incoming, schema.WEATHER, schema.WEATHER_KEY, "ts").select("site_id", "ts", *_WEATHER, "cloud_coverage")


@query("upserted_predictions", ORACLES["merged_predictions"])
def _(t):
    current = written(t.predictions())
    again = current.join(t.truth().select("sensor_id", F.col("ts").alias("target_ts"), "injected_value"), ["sensor_id", "target_ts"]).withColumns(
        {"generated_at": F.col("generated_at") - F.expr("interval 1 hour"), "predicted_kwh": F.col("injected_value")}
    ).drop("injected_value")
    how = {"update": ["generated_at", "predicted_kwh", "horizon"]}
    return _stored(t, current, again, schema.PREDICTIONS, schema.PREDICTION_KEY, "target_ts", **how)


_NEW_SCORE = "coalesce(i.score, c.score)"


@query("upserted_alerts", ORACLES["merged_alerts"].replace(_NEW_SCORE, f"CAST({_NEW_SCORE} AS DECIMAL(10,4))"))
def _(t):
    """A triage flag outlives the detectors' next run; new alerts are open."""
    moved = F.when(F.dayofmonth("ts") >= 10, F.col("ts") + F.expr("interval 60 days")).otherwise(F.col("ts"))
    current = t.alerts()
    incoming = current.drop("resolved").withColumns({"ts": moved, "score": F.col("score") + 1})
    found = _stored(t, current, incoming, schema.ALERTS, schema.ALERT_KEY, "ts", defaults={"resolved": False})
    return found.select(*schema.ALERT_KEY, "score", "resolved")
