from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from joulegrid import schema
from joulegrid.anomalies import behavioural, detect, evaluation, forest, inject, jobs, residual, rules
from joulegrid.sources import tables


def series(seed=7, sensors=3, hours=200, planted=None):
    rng = random.Random(seed)
    parts = []
    for s in range(sensors):
        values = [max(0.01, 10 + rng.gauss(0, 0.3)) for _ in range(hours)]
        for at, value in (planted or {}).items():
            if s == 0:
                values[at] = value
        parts.append((s, "2017-07-01", values))
    return parts


def quality(make, planted=None):
    return rules.detect(make(*series(planted=planted))).collect()


def test_clean_series_has_no_alerts(make):
    assert quality(make) == []


def test_negative_reading(make):
    found = quality(make, {50: -5.0})
    assert [(a.anomaly_type, a.actual_value, a.severity) for a in found] == [("negative_value", -5.0, "high")]


def test_missing_reading(make):
    assert [a.anomaly_type for a in quality(make, {30: None})] == ["missing"]
    assert [a.anomaly_type for a in quality(make, {30: "gap"})] == ["missing"]


@pytest.mark.parametrize("rows,count", [(range(60, 64), 4), (range(60, 62), 0)])
def test_zero_run(make, rows, count):
    found = quality(make, {r: 0.0 for r in rows})
    assert [a.anomaly_type for a in found] == ["zero_run"] * count
    assert all(a.score == count for a in found)


@pytest.mark.parametrize("rows,value,count", [(range(80, 115), 12.345, 35), (range(80, 85), 12.345, 0), (range(80, 104), 42.0, 0)])
def test_stuck_meter(make, rows, value, count):
    stuck = [a for a in quality(make, {r: value for r in rows}) if a.anomaly_type == "stuck_meter"]
    assert len(stuck) == count and all(a.score == count for a in stuck)


def test_isolated_spike(make):
    assert [a.anomaly_type for a in quality(make, {100: 80.0})] == ["isolated_spike"]
    assert not [a for a in quality(make, {r: 40.0 for r in range(98, 103)}) if a.anomaly_type == "isolated_spike"]


def diurnal(sensors=2, days=40, seed=11, change=None):
    rng = random.Random(seed)
    parts = []
    for s in range(sensors):
        values = [10 + 5 * math.sin(2 * math.pi * (h % 24) / 24) + rng.gauss(0, 0.5) for h in range(days * 24)]
        if change and s == 1:
            values[change[0]] = change[1]
        parts.append((s, "2017-07-01", values))
    return parts


def test_behavioural_flags_little_of_a_regular_series(make):
    assert behavioural.detect(make(*diurnal()), 4.0).count() < 0.01 * 2 * 40 * 24


def test_behavioural_flags_the_planted_reading(make):
    at = 39 * 24 + 14
    found = behavioural.detect(make(*diurnal(change=(at, 200.0))), 4.0).where("sensor_id = 1 AND actual_value = 200").collect()
    assert [a.anomaly_type for a in found] == ["behavioral_deviation"]


def test_behavioural_baseline_is_the_fourteen_before(make):
    parts = diurnal(sensors=1, days=20)
    scored = behavioural.scores(make(*parts)).where("hour(ts) = 5").orderBy("ts").collect()
    past = [round(v, 4) for v in parts[0][2][5::24]][3:17]
    median = float(np.median(past))
    assert scored[17].baseline_median == pytest.approx(median)
    assert scored[17].baseline_mad == pytest.approx(float(np.median(np.abs(np.array(past) - median))))


def test_behavioural_needs_history_and_spread(make):
    assert behavioural.scores(make(*diurnal(days=5))).where("z_score IS NOT NULL").count() == 0
    assert behavioural.scores(make((1, "2017-07-01", [10.0] * 24 * 30))).where("z_score IS NOT NULL").count() == 0


def predicted(make, spark, actual, forecast, start="2017-07-01"):
    rows = make((1, start, forecast)).select("sensor_id", F.col("ts").alias("target_ts"), F.col("consumption_kwh").alias("predicted_kwh"))
    from joulegrid.operators.joins import with_actuals

    return with_actuals(rows, make((1, start, actual)), keep_missing=False)


def test_residuals(make, spark):
    rows = residual.residuals(predicted(make, spark, [15, 5], [10, 10])).orderBy("target_ts").collect()
    assert [r.absolute_residual for r in rows] == [5, -5]
    assert [r.relative_residual for r in rows] == pytest.approx([1 / 3, -1])


def test_residual_rows_need_an_actual(make, spark):
    assert predicted(make, spark, [None, "gap"], [10, 10]).count() == 0


def test_high_residual(make, spark):
    rng = random.Random(3)
    forecast = [10.0] * 300
    actual = [10 + rng.gauss(0, 0.5) for _ in range(299)] + [110.0]
    found = residual.alerts_from(residual.residuals(predicted(make, spark, actual, forecast)), 4.0).orderBy(F.col("score").desc()).first()
    assert found.anomaly_type == "high_residual" and found.residual == pytest.approx(100)


# --- isolation forest -------------------------------------------------------------------

@pytest.fixture(scope="module")
def forest_rows(make):
    rng = random.Random(0)
    values = [5 + 10 * math.sin(math.pi * min(max(h % 24 - 6, 0), 12) / 12) + rng.gauss(0, 0.2) for h in range(60 * 24)]
    return forest.complete(forest.features(make((1, "2016-01-01", values)))).cache()


def test_previous_hour_feature(make):
    rows = forest.features(make((1, "2017-07-01", [1, 2, 3]))).orderBy("ts").collect()
    assert [r.prev_hour_kwh for r in rows] == [None, 1, 2]


def test_outlier_scores_above_typical_rows(forest_rows, tmp_path):
    path = str(tmp_path / "f")
    forest.fit_and_save(forest_rows, path)
    typical = forest.score_saved(forest_rows.orderBy("ts").limit(50), path).agg(F.max("score")).first()[0]
    outlier = forest_rows.orderBy(F.col("ts").desc()).limit(1).withColumn("consumption_kwh", F.lit(500.0))
    scored = forest.score_saved(outlier, path)
    assert 0 < typical < scored.first().score <= 1
    alert = forest.alerts_from(scored, scored.first().score).first()
    assert alert.severity == "medium" and "'consumption_kwh'" in alert.explanation
    assert forest.alerts_from(scored, scored.first().score / 1.6).first().severity == "high"


def test_forest_ignores_later_rows(make, tmp_path):
    def nodes(last):
        parts = diurnal(sensors=1, days=30)
        parts[0][2][-1] = last
        rows = forest.complete(forest.features(make(*parts))).where("ts < timestamp'2017-07-29'")
        return sorted(map(tuple, forest.fit(forest.with_scaled(rows, forest.scaling(rows)), trees=5).collect()))

    assert nodes(10.0) == nodes(9000.0)


def test_forest_sampling_is_exact_and_bounded(spark):
    rows = spark.range(30_000).select(
        (F.col("id") % 7).alias("sensor_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.array(F.rand(1), F.rand(2)).alias("scaled")
    ).cache()
    for trees, size in ((10, 64), (200, 32)):
        counts = forest.sample(rows, trees, size).groupBy("tree").count().collect()
        assert len(counts) == trees and {r["count"] for r in counts} == {size}


def test_path_lengths_follow_brute_force(spark):
    """Scores equal a plain descent of the same node table."""
    rng = np.random.default_rng(0)
    points = rng.normal(size=(300, len(forest.FEATURES)))
    rows = spark.createDataFrame([(1, i, [float(x) for x in p]) for i, p in enumerate(points)], "sensor_id long, s long, scaled array<double>").select("sensor_id", F.timestamp_seconds(F.col("s") * 3600).alias("ts"), "scaled")
    nodes = spark.createDataFrame(forest.fit(rows, trees=7, size=64).collect())
    table = {}
    for n in nodes.collect():
        table.setdefault(n.tree, {})[n.node] = n
    def path(tree, p):
        node = tree[0]
        while node.feature >= 0:
            node = tree[node.left if p[node.feature] <= node.threshold else node.right]
        return node.path
    for r in forest.score(rows, nodes, 64).limit(40).collect():
        mean = sum(path(t, r.scaled) for t in table.values()) / len(table)
        assert r.score == pytest.approx(2 ** (-mean / forest.expected_path(64)))


# --- injection --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def clean(make):
    rng = random.Random(2)
    return make(*[(s, "2017-07-01", [max(0.1, rng.gauss(10, 1)) for _ in range(2000)]) for s in range(12)]).cache()


PERIOD = ("2017-07-01", "2017-09-20")


def truth_rows(clean, seed=42, rate=0.05):
    return inject.injections(clean, *PERIOD, "validation", seed, rate)


def test_injection_is_reproducible(clean):
    first, again, other = (sorted(map(str, truth_rows(clean, s).collect())) for s in (42, 42, 43))
    assert first == again and first != other


def test_injection_types_sizes_and_values(clean):
    rows = truth_rows(clean).collect()
    by_type = {}
    for r in rows:
        by_type.setdefault(r.anomaly_type, []).append(r)
    assert set(by_type) == {t[0] for t in inject.TYPES}
    for kind, shortest, longest, low, high in inject.TYPES:
        spans = {}
        for r in by_type[kind]:
            spans.setdefault((r.sensor_id, int(r.ts.timestamp() // 3600 - 17348 * 24) // 72), []).append(r)
        for span in spans.values():
            hours = sorted(r.ts for r in span)
            assert shortest <= len(span) <= longest
            assert (hours[-1] - hours[0]).total_seconds() == (len(span) - 1) * 3600
            if low is not None:
                for r in span:
                    ratio = float(r.injected_value) / float(r.original_value)
                    assert low - 1e-3 <= ratio <= high + 1e-3
            elif kind == "stuck_meter":
                assert {r.injected_value for r in span} == {min(span, key=lambda r: r.ts).original_value}
            else:
                assert {float(r.injected_value) for r in span} == {0.0}
    assert len({(r.sensor_id, r.ts) for r in rows}) == len(rows)


def test_injection_prevalence_holds_at_any_size(make):
    def spans(sensors):
        rows = make(*[(s, "2017-07-01", [float(1 + h % 7) for h in range(720)]) for s in range(sensors)])
        truth = inject.injections(rows, "2017-07-01", "2017-07-31", "validation", 42, 0.05)
        slot = F.floor(F.unix_timestamp("ts") / (3600 * 72))
        return truth.select("sensor_id", slot).distinct().count() / (sensors * 10)

    assert spans(40) > 0.2 and abs(spans(160) - spans(40)) < 0.06


def test_stitched_series_differs_only_at_truth(clean):
    truth = truth_rows(clean)
    stitched = inject.stitched(clean, truth)
    changed = stitched.exceptAll(clean.select("sensor_id", "ts", "consumption_kwh"))
    assert changed.join(truth, ["sensor_id", "ts"], "left_anti").count() == 0 and stitched.count() == clean.count()


# --- metrics ----------------------------------------------------------------------------

def keys(spark, *pairs):
    return spark.createDataFrame([(s, h) for s, h in pairs], "sensor_id long, h long").select("sensor_id", F.timestamp_seconds(F.col("h") * 3600).alias("ts"))


def test_confusion(spark):
    row = evaluation.confusion(keys(spark, (1, 1), (1, 2), (2, 3)), keys(spark, (1, 1), (1, 26)), spark.range(10)).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 1, 2, 6)


@pytest.mark.parametrize("counts,expected", [
    ((8, 2, 2, 88), (0.8, 0.8, 0.8, 2 / 90, 0.96)), ((0, 0, 5, 95), (None, 0.0, None, 0.0, 0.95)), ((0, 3, 5, 92), (0.0, 0.0, 0.0, 3 / 95, 0.92)),
])
def test_ratios(spark, counts, expected):
    row = evaluation._with_ratios(spark.createDataFrame([counts], "tp long, fp long, fn long, tn long")).first()
    for name, value in zip(evaluation.RATIOS, expected):
        assert row[name] == (None if value is None else pytest.approx(value))


def scored_rows(spark):
    return keys(spark, (1, 1), (1, 2), (1, 3), (1, 4)).withColumn("score", F.when(F.hour("ts") == 4, 2.0).otherwise(5.0))


def test_sweep_and_best(spark):
    truth = keys(spark, (1, 1), (1, 2), (1, 3))
    best = evaluation.best_threshold(evaluation.sweep(scored_rows(spark), truth, spark.range(10), [1, 2, 3, 6])).first()
    assert best.threshold == 3.0 and best.f1 == 1.0


def test_sweep_tie_takes_the_lower_threshold(spark):
    rows = keys(spark, (1, 1)).withColumn("score", F.lit(5.0))
    assert evaluation.best_threshold(evaluation.sweep(rows, keys(spark, (1, 1)), spark.range(5), [3.0, 1.0])).first().threshold == 1.0


def test_recall_by_type(spark):
    truth = keys(spark, (1, 1), (1, 2), (1, 3), (1, 4)).withColumn("anomaly_type", F.when(F.hour("ts") <= 2, "spike").otherwise("drop"))
    found = evaluation.recall_by_type(truth, keys(spark, (1, 1), (1, 3), (1, 4), (9, 9)))
    assert {r.anomaly_type: r.recall for r in found.collect()} == {"spike": 0.5, "drop": 1.0}


def test_recall_keeps_a_silent_detector(spark):
    truth = keys(spark, (1, 1), (1, 2)).withColumn("anomaly_type", F.lit("spike"))
    found = evaluation.recall_by_type(truth, keys(spark, (1, 1)).withColumn("method", F.lit("a")), ["a", "b"])
    assert {(r.method, r.n, r.tp, r.recall) for r in found.collect()} == {("a", 2, 1, 0.5), ("b", 2, 0, 0.0)}


def test_class_balance(spark):
    row = evaluation.class_balance(spark.range(100), keys(spark, (1, 1), (1, 2), (2, 1))).first()
    assert (row.anomaly_rate_pct, row.normal_slots, row.affected_sensors) == (3.0, 97, 2)


def test_top_alert(spark):
    rows = spark.sql(
        "SELECT 1L sensor_id, timestamp'2017-01-01' ts, m method, 'v1' detector_version, t anomaly_type, s score "
        "FROM VALUES ('x', 'b', 2.0D), ('x', 'a', 2.0D), ('x', 'c', 1.0D), ('y', 'd', 0.5D) v(m, t, s)"
    )
    assert {(r.method, r.anomaly_type) for r in rules.top_alert(rows).collect()} == {("x", "a"), ("y", "d")}


# --- jobs -------------------------------------------------------------------------------

def test_evaluation_then_detection(make, spark, tmp_path):
    readings = make(*diurnal(sensors=6, days=45)).cache()
    predictions = readings.select(
        "sensor_id", F.expr("ts + interval 24 hours").alias("target_ts"), F.col("consumption_kwh").alias("predicted_kwh")
    )
    periods = {"train": ("2017-07-01", "2017-07-25"), "validation": ("2017-07-25", "2017-08-04"), "test": ("2017-08-04", "2017-08-15")}
    out, alerts = str(tmp_path / "eval"), str(tmp_path / "alerts")
    with pytest.raises(FileNotFoundError, match="evaluation job"):
        jobs.run_detection(spark, readings, predictions, out, alerts)
    found = jobs.evaluate(spark, readings, predictions, periods, out, rate=0.1, trees=20)
    assert {r.method for r in found["thresholds"].collect()} == set(jobs.METHODS[1:])
    assert {(r.split_name, r.method) for r in found["detector_metrics"].collect()} == {(s, m) for s in ("validation", "test") for m in jobs.METHODS}
    stuck = [r for r in found["recall"].collect() if r.method == "data_quality" and r.anomaly_type == "stuck_meter"]
    assert stuck and all(r.recall == 1.0 for r in stuck)
    counts = {r.method: r.alerts for r in jobs.run_detection(spark, readings, predictions, out, alerts).collect()}
    again = {r.method: r.alerts for r in jobs.run_detection(spark, readings, predictions, out, alerts).collect()}
    assert counts == again and counts["all"] == sum(v for k, v in counts.items() if k != "all")
    assert {f.name for f in schema.struct(schema.ALERTS).fields} <= set(tables.read_or_none(spark, alerts).columns)
    from joulegrid.plans import report

    charts = report.detector_charts(found)
    assert charts["recall_test"].count() >= 1 and charts["sweep_curves"].count() >= 28


def test_union_pads_missing_residual(make, spark):
    both = detect.union_alerts(rules.detect(make(*series(planted={50: -5.0}))), behavioural.detect(make(*diurnal(change=(39 * 24 + 14, 200.0))), 4.0))
    assert both.where("residual IS NOT NULL").count() == 0 and {r.method for r in both.collect()} == {"data_quality", "behavioral"}


def test_the_forest_sample_is_drawn_by_compiled_code(spark, capsys):
    """Two hundred hashes a row: as a function over an array they were interpreted, one by one."""
    rows = spark.range(2000).select(F.col("id").alias("sensor_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.array(F.lit(1.0)).alias("scaled"))
    chosen = forest.sample(rows, trees=5, size=16, seed=42)
    chosen.explain()
    assert "lambda" not in capsys.readouterr().out
    draw = F.pmod(F.xxhash64("sensor_id", F.unix_timestamp("ts"), F.lit(3), F.lit(42), F.lit("cut")), F.lit(1 << 40))
    want = [r.sensor_id for r in rows.orderBy(draw).limit(16).collect()]
    assert sorted(r.sensor_id for r in chosen.where("tree = 3").collect()) == sorted(want)
