from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import column
from joulegrid.catalog.standins import with_tables
from joulegrid.functions import calendar as cal, stats
from joulegrid.operators import aggregates as ag, joins, lookups


@pytest.fixture(scope="module")
def dims(spark):
    def build(zone="US/Eastern", sensors=(1, 2)):
        sites = spark.createDataFrame([(1, "s", zone)], "site_id long, site_code string, timezone string")
        buildings = spark.createDataFrame([(s * 10, f"b{s}", 1, "Office", 100.0) for s in sensors], "building_id long, building_code string, site_id long, primary_use string, area_sqm double")
        meters = spark.createDataFrame([(s, s * 10, "electricity", "kWh") for s in sensors], "sensor_id long, building_id long, meter_type string, unit string")
        return sites, buildings, meters, lookups.electricity_sensors(buildings, meters, sites)

    return build


@pytest.mark.parametrize("zone,hour", [("US/Eastern", 12), ("UTC", 16)])
def test_hour_profile_is_local(make, dims, zone, hour):
    row = ag.profile(make((1, "2016-06-15 16:00:00", [42])), dims(zone)[3], "hour").first()
    assert (row.hour, row.mean_kwh) == (hour, 42)


def test_weekday_and_weekend_profiles(make, dims):
    readings = make((1, "2016-06-11 16:00:00", [100]), (1, "2016-06-13 16:00:00", [10]))
    assert {r.day_of_week: r.mean_kwh for r in ag.profile(readings, dims()[3], "day_of_week").collect()} == {6: 100, 1: 10}
    assert {r.is_weekend: r.mean_kwh for r in ag.profile(readings, dims()[3], "is_weekend").collect()} == {True: 100, False: 10}


def test_month_profile_and_peaks(make, dims):
    readings = make((1, "2016-01-10 12:00:00", [5]), (1, "2016-02-10 12:00:00", [30, 7]))
    assert {r.month: r.total_kwh for r in ag.profile(readings, dims()[3], "month").collect()} == {1: 5, 2: 37}
    assert {r.month: float(r.peak_kwh) for r in ag.peak_per_month(readings, dims()[3]).collect()} == {1: 5, 2: 30}


def test_peak_at_a_month_edge_is_local(make, dims):
    readings = make((1, "2016-02-01 02:00:00", [9]), (1, "2016-02-10 12:00:00", [3]))
    assert {r.month: float(r.peak_kwh) for r in ag.peak_per_month(readings, dims("US/Eastern")[3]).collect()} == {1: 9, 2: 3}


def test_summary(make):
    row = ag.missing_hours(ag.sensor_summary(make((1, "2016-01-01", [10, 20, 30, None]))), 10).first()
    assert (row.observations, row.row_count, row.mean_kwh, row.min_kwh, row.max_kwh, row.missing_hours) == (3, 4, 20, 10, 30, 7)


def test_median_and_cv(make):
    row = ag.sensor_summary(make((1, "2016-01-01", [10, 20, 30, 40]))).first()
    assert row.median_kwh == 25 and row.cv == pytest.approx(row.std_kwh / 25)


def test_daily_buckets(make):
    readings = make((1, "2016-01-01 10:00:00", [10, 10]), (1, "2016-01-02 10:00:00", [5, 5]))
    assert [(r.total_kwh, r.observations) for r in ag.time_buckets(readings, "daily").orderBy("bucket").collect()] == [(20, 2), (10, 2)]


def test_unknown_granularity():
    with pytest.raises(ValueError, match="granularity"):
        cal.truncation_unit("yearly")


def test_range_is_inclusive(make):
    readings = make((1, "2016-01-01", [10, 20, 30, 40, 50]))
    rows = lookups.series(readings, "sensor_id", "ts", 1, "2016-01-01T01:00:00", "2016-01-01T03:00:00")
    assert [float(v) for v in column(rows, "consumption_kwh")] == [20, 30, 40]
    assert readings.where(lookups.in_range(F.col("ts"), "2016-01-01", "2016-01-01")).count() == 5


def test_start_after_end():
    with pytest.raises(ValueError, match="start must not be after end"):
        lookups.in_range(F.lit(None), "2016-01-02", "2016-01-01")


def test_top_peaks(make):
    assert [float(v) for v in column(lookups.top_peaks(make((1, "2016-01-01", [10, None, 30, 20]))), "consumption_kwh", "rank")] == [30, 20, 10]
    assert [float(v) for v in column(lookups.top_peaks(make((1, "2016-01-01", [10, 99, 20, 5, 50])), 3), "consumption_kwh", "rank")] == [99, 50, 20]


def test_dataset_day_total(make, dims):
    rows = ag.local_day_totals(make((1, "2016-01-01", [10] * 3), (2, "2016-01-01", [5] * 3)), dims("UTC")[3]).collect()
    assert [r.total_kwh for r in rows] == [45]


def test_site_weather_and_correlation(make, dims, spark):
    readings = make((1, "2016-01-01", [10, 20, 30, 40, 50]))
    weather = spark.createDataFrame([(1, datetime(2016, 1, 1, h), float(h + 1), None) for h in range(5)], "site_id long, ts timestamp, air_temp_c double, cloud_coverage double")
    joined = joins.site_weather(readings, dims(sensors=(1,))[3], weather)
    found = {r.measure: (r.r, r.n_pairs) for r in ag.weather_correlations(joined, ["air_temp_c", "cloud_coverage"]).collect()}
    assert found["air_temp_c"] == (pytest.approx(1.0), 5) and found["cloud_coverage"] == (None, 0)
    totals = joins.site_totals(make((1, "2016-01-01", [10, 20]), (2, "2016-01-01", [10, 20])), dims()[3])
    assert column(totals, "site_kwh") == [20, 40]


@pytest.mark.parametrize("rows,expected", [
    ([(1, 2), (2, 4), (None, 6), (4, None)], (1.0, 2)), ([(1, 2)], (None, 1)), ([(3, 1), (3, 2), (3, 5)], (None, 3)),
])
def test_pearson(spark, rows, expected):
    r, n = stats.pearson(F.col("x"), F.col("y"))
    row = spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b)) for a, b in rows], "x double, y double").agg(r.alias("r"), n.alias("n")).first()
    assert (row.r, row.n) == (None if expected[0] is None else pytest.approx(expected[0]), expected[1])


def test_building_without_readings_is_absent(make, dims):
    _, buildings, meters, _ = dims()
    assert [r.building_id for r in ag.building_comparison(make((1, "2016-01-01", [1, 2])), meters, buildings).collect()] == [10]


def test_forecast_view(make, spark):
    predictions = make((1, "2016-01-01", [12, 12])).select("sensor_id", F.col("ts").alias("target_ts"), F.col("consumption_kwh").alias("predicted_kwh"))
    rows = joins.with_actuals(predictions, make((1, "2016-01-01", [15])), keep_missing=True).orderBy("target_ts").collect()
    assert [(r.actual_kwh, r.residual) for r in rows] == [(15, 3), (None, None)]


def test_alert_summary(spark):
    alerts = spark.sql("SELECT * FROM VALUES ('data_quality', 'x', 'high', false), ('data_quality', 'x', 'medium', false), ('behavioral', 'y', 'medium', false) v(method, anomaly_type, severity, resolved)")
    found = {(r.part, r.value): (r.alerts, r.unresolved) for r in ag.alert_summary(alerts).collect()}
    assert found[("all", None)] == (3, 3) and found[("method", "data_quality")] == (2, 2) and found[("severity", "medium")] == (2, 2)


def test_key_lookup_and_page(spark, dims):
    sites, buildings, _, _ = dims(sensors=(1, 2, 3))
    assert lookups.one_by_key(buildings, "building_id", 20).first().building_code == "b2"
    with pytest.raises(ValueError, match="building_id"):
        lookups.one_by_key(buildings, "building_id", 99)
    rows = lookups.list_buildings(buildings, limit=1, offset=1).collect()
    assert [(r.building_id, r.total) for r in rows] == [(20, 3)]


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (None,)], "x double")
    assert {r.bin: r.n for r in ag.histogram(rows, "x", 10).collect()} == {1: 1, 2: 1, 10: 2}
    assert {r.bin: r.n for r in ag.histogram(rows.where("x = 1"), "x", 10).collect()} == {1: 1}


def test_alert_context(make):
    readings = make((1, "2016-01-01", range(100)), (2, "2016-01-01", range(100)))
    alerts = readings.where("sensor_id = 1 AND hour(ts) = 5 AND day(ts) = 2").withColumn("method", F.lit("m"))
    found = lookups.alert_context(alerts, readings, 12)
    assert found.count() == 25 and found.where("sensor_id = 2").count() == 0


def test_rollup_serves_buckets(make):
    readings = make((1, "2016-01-01", [1, 5, None, 7] * 40))
    def rounded(rows):
        return sorted((str(r.bucket), round(r.mean_kwh, 9), r.total_kwh, round(r.std_kwh, 6), r.observations) for r in rows.collect())
    assert rounded(ag.buckets_from_rollup(ag.daily_rollup(readings), "weekly")) == rounded(ag.time_buckets(readings, "weekly"))


def test_oversized_dimension_is_not_broadcast(spark):
    side = spark.range(100).withColumnRenamed("id", "k")
    fits, too_big = joins.bounded(side), joins.bounded(side, limit=100)
    assert too_big is side and fits is not side


def test_registered_queries_have_oracles_or_reasons():
    from joulegrid.catalog import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    unchecked = set(QUERIES) - set(ORACLES)
    assert unchecked <= {
        "forest_scores", "injected_benchmark", "ridge_forecast", "random_forest_forecast", "gradient_boosting_forecast",
        "ridge_alpha_search", "model_comparison", "forest_statistics", "isolation_alerts", "detection_job", "company_forecasts",
    }
    assert with_tables("SELECT 1", "alerts").count("base AS MATERIALIZED (") == 1


@pytest.mark.parametrize("name", ["building_comparison", "quality_alerts", "latest_day_forecast", "wall_clock_to_utc"])
def test_oracle_on_smallest_data(spark, name):
    from oracle_check import difference, oracle_connection
    from joulegrid.catalog import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    assert difference(QUERIES[name](spark, sf).toPandas(), oracle_connection(sf).execute(ORACLES[name]).df()) is None
