from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import column
from joulegrid.anomalies import behavioural, forest as isolation, residual, rules
from joulegrid.forecasting import features as feat
from joulegrid.functions import calendar as cal
from joulegrid.functions.medians import bracket, exact_percentiles, with_exact_median
from joulegrid.operators import joins, lookups, series as ser


def lagged(readings, **kwargs):
    return ser.own_rows(ser.add_lags(ser.chunked_grid(readings, 168, 0, **kwargs)), *[f"lag_{k}" for k in ser.LAGS])


def test_grid_fills_gaps_per_sensor(make):
    grid = ser.hourly_grid(make((1, "2016-01-01", [1, 2, "gap", 4, 5])))
    assert grid.count() == 5
    assert grid.where("consumption_kwh IS NULL").count() == 1


def test_grid_does_not_fill_between_sensors(make):
    assert ser.hourly_grid(make((1, "2016-01-01", [1, 2, 3]), (2, "2016-06-01", [1, 2, 3]))).count() == 6


@pytest.mark.parametrize("ts,hour", [("2016-06-15 16:00", 12)])
def test_local_hour(spark, ts, hour):
    row = spark.range(1).select(F.hour(cal.local(F.lit(ts).cast("timestamp"), F.lit("US/Eastern"))).alias("h")).first()
    assert row.h == hour


def test_day_of_week_starts_on_sunday(spark):
    rows = spark.createDataFrame([("2016-06-11 16:00",), ("2016-06-13 16:00",)], "s string").select(
        *cal.calendar_columns(cal.local(F.col("s").cast("timestamp"), F.lit("US/Eastern")))
    ).collect()
    assert [(r.day_of_week, r.is_weekend) for r in rows] == [(6, True), (1, False)]


def test_lag_one_is_the_origin_itself(make):
    assert column(lagged(make((1, "2016-01-01", [10, 20, 30, 40, 50]))), "lag_1") == [10, 20, 30, 40, 50]


def test_lag_24(make):
    values = column(lagged(make((1, "2016-01-01", range(30)))), "lag_24")
    assert values[25] == 2
    assert values[:23] == [None] * 23


def test_lags_stay_inside_a_sensor(make):
    rows = lagged(make((1, "2016-01-01", [1, 2, 3]), (2, "2016-01-01", [100, 200, 300])))
    assert column(rows.where("sensor_id = 2"), "lag_2")[0] is None


def rolled(readings):
    return ser.own_rows(ser.add_rolling(ser.chunked_grid(readings, 168, 0)), *feat.ROLLING_COLUMNS)


def test_rolling_mean_is_strictly_earlier(make):
    values = column(rolled(make((1, "2016-01-01", range(25)))), "rolling_24h_mean")
    assert values[24] == 11.5
    assert values[:24] == [None] * 24


def test_rolling_deviation_excludes_the_origin(make):
    assert column(rolled(make((1, "2016-01-01", [0] * 24 + [1000, 1000]))), "rolling_24h_std")[24] == 0.0


def test_rolling_needs_a_full_window(make):
    values = column(rolled(make((1, "2016-01-01", [1] * 10 + [None] + [1] * 30))), "rolling_24h_mean")
    assert values[30] is None and values[35] == 1.0


def test_targets(make):
    rows = ser.own_rows(ser.add_targets(ser.chunked_grid(make((1, "2016-01-01", [10, 20, 30, 40, 50])), 0, 24)), "target_h1", "target_h2")
    assert column(rows, "target_h1") == [20, 30, 40, 50, None]
    assert column(rows, "target_h2") == [30, 40, 50, None, None]


def test_melted_horizons(spark):
    origins = spark.sql("SELECT 1L sensor_id, timestamp'2016-01-01' + make_dt_interval(0, id) origin_ts, 1.0D target_h1, 2.0D target_h2 FROM range(3)")
    rows = ser.melt_horizons(origins, ["sensor_id", "origin_ts"], (1, 2))
    assert rows.count() == 6
    assert rows.where("unix_timestamp(target_ts) - unix_timestamp(origin_ts) <> horizon * 3600").count() == 0


def test_midnight_origins(make, spark):
    assert lookups.local_midnight(make((1, "2016-01-01", range(48))).withColumn("tz", F.lit("UTC")), "ts", "tz").count() == 2
    eastern = make((1, "2016-06-15 03:00:00", [1, 2, 3])).withColumn("tz", F.lit("US/Eastern"))
    assert [str(r.ts) for r in lookups.local_midnight(eastern, "ts", "tz").collect()] == ["2016-06-15 04:00:00"]


@pytest.mark.parametrize("hours,count,at,expected", [(24, 48, 29, 5), (168, 200, 180, 12)])
def test_seasonal_naive(make, hours, count, at, expected):
    readings = make((1, "2016-01-01", range(count)))
    found = joins.seasonal_naive(readings.select("sensor_id", F.col("ts").alias("target_ts")), readings, hours)
    assert column(found, "predicted_kwh", "target_ts")[at] == expected


def test_seasonal_naive_without_history(make):
    readings = make((1, "2016-01-01", range(10)))
    found = joins.seasonal_naive(readings.select("sensor_id", F.col("ts").alias("target_ts")), readings, 24)
    assert found.where("predicted_kwh IS NOT NULL").count() == 0


# --- chunk borders never show -----------------------------------------------------------

def noisy(make, sensors=2, hours=900, seed=3):
    rng = random.Random(seed)
    parts = []
    for s in range(sensors):
        values = [round(10 + 5 * ((h % 24) > 8) + rng.random() * 3, 4) for h in range(hours)]
        for start, length, value in ((100, 70, 7.7), (300, 9, 0.0), (500, 40, None), (620, 1, 90.0), (700, 33, 3.25)):
            values[start:start + length] = [value] * length
        for h in rng.sample(range(1, hours - 1), 20):
            values[h] = "gap"
        parts.append((s, "2016-01-03 05:00:00", values))
    return make(*parts)


def rows_of(frame):
    return sorted(tuple(str(v) for v in r) for r in frame.collect())


@pytest.mark.parametrize("chunk", [350, 401])
def test_chunk_size_does_not_change_features(make, chunk):
    readings = noisy(make)
    assert rows_of(lagged(readings, chunk_hours=chunk)) == rows_of(lagged(readings))
    small = ser.add_targets(ser.add_rolling(ser.chunked_grid(readings, 168, 24, chunk)))
    large = ser.add_targets(ser.add_rolling(ser.chunked_grid(readings, 168, 24)))
    names = [*feat.ROLLING_COLUMNS, "target_h24"]
    assert rows_of(ser.own_rows(small, *names)) == rows_of(ser.own_rows(large, *names))


@pytest.mark.parametrize("chunk", [24, 31])
def test_chunk_size_does_not_change_rule_alerts(make, chunk):
    """Stuck and zero runs longer than several chunks are stitched whole."""
    readings = noisy(make)
    assert rows_of(rules.detect(readings, chunk)) == rows_of(rules.detect(readings))


def test_chunk_size_does_not_change_behavioural_scores(make):
    readings = noisy(make)
    assert rows_of(behavioural.scores(readings, chunk_hours=340)) == rows_of(behavioural.scores(readings))


def test_chunk_size_does_not_change_residuals(make, spark):
    readings = noisy(make, sensors=2, hours=400)
    joined = readings.where("consumption_kwh IS NOT NULL").select(
        "sensor_id", F.col("ts").alias("target_ts"), F.lit(10.0).alias("predicted_kwh"), F.col("consumption_kwh").cast("double").alias("actual_kwh")
    )
    def rounded(rows):
        return rows_of(rows.withColumn("standardized_residual", F.round("standardized_residual", 9)).withColumn("residual_std", F.round("residual_std", 9)))
    assert rounded(residual.residuals(joined, chunk_rows=80)) == rounded(residual.residuals(joined))


def test_positions_count_rows_not_hours(make):
    rows = make((1, "2016-01-01", [1, "gap", "gap", 2] + ["gap"] * 50 + [3]))
    assert column(ser.with_positions(rows, ["sensor_id"], "ts", chunk_hours=10), "position") == [1, 2, 3]


# --- exact medians ----------------------------------------------------------------------

def test_exact_median_matches_sorting(spark):
    rng = random.Random(5)
    data, expected = [], {}
    for key, size in enumerate([1, 2, 3, 4, 7, 100, 2501, 30000]):
        values = [rng.choice([rng.random() * 100, 5.0]) for _ in range(size)]
        data += [(key, v) for v in values] + [(key, None)]
        s = sorted(values)
        expected[key] = (s[(size - 1) // 2] + s[size // 2]) / 2
    data.append((99, None))
    rows = spark.createDataFrame(data, "k int, x double").repartition(7)
    stats = rows.groupBy("k").agg(F.count("x").alias("_n"), bracket(F.col("x")).alias("_bracket"))
    found = {r.k: r["median"] for r in with_exact_median(rows, stats, ["k"], "x").collect()}
    assert found.pop(99) is None
    assert found == expected


def test_exact_percentiles_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (1, 2, 10, 5000, 40_000):
        values = rng.normal(size=size)
        rows = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
        percents = [0, 50, 80, 99, 99.5, 99.9, 100]
        assert exact_percentiles(rows, "x", percents) == pytest.approx(list(np.percentile(values, percents)), abs=1e-12)


def test_percentile_brackets_narrow_to_the_same_values(spark, monkeypatch):
    from joulegrid.functions import medians

    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=3000), np.full(500, 1.0), rng.integers(0, 5, 500)])
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    monkeypatch.setattr(medians, "_ORDERED", 50)
    percents = [0, 1, 25, 50, 90, 99.9, 100]
    assert exact_percentiles(rows, "x", percents) == pytest.approx(list(np.percentile(values, percents)), abs=1e-12)


def test_baseline_frames_are_the_windows(spark, make, monkeypatch):
    """Frames in arrays beside the window functions: gaps, NULLs, equal readings, chunk borders and batches of few rows."""
    rng = random.Random(7)
    values = [round(20 + 5 * rng.random(), 2) for _ in range(900)]
    values[400:440] = [3.25] * 40
    values[100], values[500], values[501], values[700] = None, "gap", "gap", None
    readings = make((1, "2016-01-01 00:00:00", values), (2, "2016-01-03 05:00:00", [7.5] * 380), (3, "2016-01-01 00:00:00", [1.0, None, 2.0]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "57")
    try:
        for chunk_hours in (400, ser.CHUNK_HOURS):
            chunked = ser.chunked_grid(readings, 24 * ser.BASELINE_DAYS, 0, chunk_hours)
            names = ("consumption_kwh", "lag_2", "rolling_24h_mean", "rolling_24h_std", "rolling_168h_mean", "z_score")
            want = ser.own_rows(ser.add_baseline(ser.add_rolling(ser.add_lags(chunked, (2,)))), *names)

            def rounded(rows):
                return sorted((r.sensor_id, str(r.ts), *[None if r[c] is None else round(float(r[c]), 8) for c in names]) for r in rows.collect())

            got = rounded(ser.baseline_frames(chunked))
            assert got == rounded(want) and len(got) == 1283 and any(g[-1] is not None for g in got)
            zones = spark.createDataFrame([(1, "Asia/Kolkata"), (2, "US/Eastern"), (3, "UTC")], "sensor_id long, tz string")
            chunked = ser.chunked_grid(readings, 168, 24, chunk_hours, zones)
            names = [*feat.LAG_COLUMNS, *feat.ROLLING_COLUMNS, *[f"target_h{h}" for h in ser.HORIZONS]]
            want = ser.own_rows(ser.add_targets(ser.add_rolling(ser.add_lags(chunked))).where("is_origin"), *names)
            got = rounded(ser.origin_frames(chunked, names))
            assert got == rounded(want) and len(got) > 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_deviation_frames_are_the_windows_and_frames_of_some_hours_those_of_all(spark, make):
    """Median, spread and z in arrays beside the window functions; a period's frames still reach back over its start."""
    rng = random.Random(11)
    values = [round(20 + 5 * rng.random(), 2) for _ in range(900)]
    values[100], values[500], values[700] = None, "gap", None
    readings = make((1, "2016-01-01 00:00:00", values), (2, "2016-01-03 05:00:00", [7.5] * 380))
    names = ("consumption_kwh", "baseline_median", "baseline_mad", "z_score")
    first = 403_224  # 2016-01-01, in hours since the epoch

    def rounded(rows, columns):
        return sorted((r.sensor_id, str(r.ts), *[None if r[c] is None else round(float(r[c]), 8) for c in columns]) for r in rows.collect())

    for chunk_hours in (400, ser.CHUNK_HOURS):
        want = rounded(ser.own_rows(ser.add_baseline(ser.chunked_grid(readings, 24 * ser.BASELINE_DAYS, 0, chunk_hours)), *names), names)
        found = behavioural.scores(readings, chunk_hours=chunk_hours)
        assert rounded(found, names) == want and found.schema["consumption_kwh"] == readings.schema["consumption_kwh"]
        some = [row for row in want if "2016-01-20" <= row[1] < "2016-02-02"]
        hours = (first + 19 * 24, first + 32 * 24)
        assert rounded(behavioural.scores(readings, chunk_hours=chunk_hours, hours=hours), names) == some and any(row[-1] is not None for row in some)
        inputs = isolation.FEATURES
        every = [row for row in rounded(isolation.features(readings, chunk_hours), inputs) if "2016-01-20" <= row[1] < "2016-02-02"]
        assert rounded(isolation.features(readings, chunk_hours, hours), inputs) == every


def test_places_of_a_packed_tree_hold_the_path_of_every_row(spark):
    """Leaves of any depth repeat their path length on the last level."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(200, 10))
    nodes = isolation._grow(points[:60], 0, np.random.default_rng(1))
    feature, threshold, path, levels = isolation._packed(pd.DataFrame(nodes, columns=[c.split(" ")[0] for c in isolation.NODES.split(", ")]))[0]
    for point in points:
        node, at = 0, 0
        while nodes[node][2] >= 0:
            node = nodes[node][4] if point[nodes[node][2]] <= nodes[node][3] else nodes[node][5]
        for _ in range(levels):
            at = 2 * at + (1 if point[feature[at]] <= threshold[at] else 2)
        assert path[at - (2**levels - 1)] == nodes[node][6]
