from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from joulegrid.forecasting import company, features as feat, jobs, metrics, models
from joulegrid.functions import medians
from joulegrid.operators import aggregates as ag, lookups
from joulegrid import schema
from joulegrid.sources import files, tables
from joulegrid.plans import report


def static_of(spark, *sensors, tz="UTC"):
    return spark.createDataFrame(
        [(s, s, 1, tz, 100.0 + s, "Office" if s % 2 else "Lodging", 3.0 if s == 1 else None, None if s == 1 else 9.0) for s in sensors],
        "sensor_id long, building_id long, site_id long, tz string, area_sqm double, primary_use string, number_of_floors double, occupants double",
    )


# --- leakage and splits -----------------------------------------------------------------

def test_no_feature_exceeds_the_origin_on_a_rising_series(make, spark):
    origins = feat.origins(make((1, "2016-01-01", range(250))), static_of(spark, 1))
    rows = feat.expand(feat.usable(origins)).collect()
    assert rows
    for r in rows:
        assert all(r[c] <= r.lag_1 for c in feat.LAG_COLUMNS + ["rolling_24h_mean", "rolling_168h_mean"])
        assert r.target_kwh is None or r.target_kwh == r.lag_1 + r.horizon


def test_origins_never_straddle_a_split(make, spark):
    table = feat.feature_table(make((1, "2016-01-01", range(400))), static_of(spark, 1))
    periods = {"train": ("2016-01-01", "2016-01-10"), "validation": ("2016-01-10", "2016-01-20")}
    split = feat.with_split(table, periods)
    assert {r.split for r in split.select("split").distinct().collect()} == {"train", "validation"}
    assert split.groupBy("sensor_id", "origin_ts").agg(F.countDistinct("split").alias("n"), F.count("*").alias("c")).where("n <> 1 OR c <> 24").count() == 0
    last = split.where("origin_ts = timestamp'2016-01-09'")
    assert last.where("split = 'train'").count() == 24


def test_split_helper_matches_labels(make, spark):
    rows = make((1, "2016-01-01", range(72)))
    parts = lookups.split_periods(rows, "ts", {"train": ("2016-01-01", "2016-01-02"), "test": ("2016-01-02", "2016-01-03")})
    assert [parts[p].count() for p in ("train", "test")] == [24, 24]


# --- metrics ----------------------------------------------------------------------------

def pairs(spark, *rows):
    return spark.createDataFrame(rows, "y double, p double")


def test_metrics(spark):
    m = metrics.overall(pairs(spark, (10.0, 12.0), (20.0, 18.0), (30.0, 33.0), (40.0, 36.0)), "y", "p").first()
    assert (m.n, m.mae) == (4, 2.75)
    assert m.rmse == pytest.approx(math.sqrt(8.25)) and m.cv_rmse_pct == pytest.approx(math.sqrt(8.25) / 25 * 100)
    assert m.r2 == pytest.approx(1 - 33 / 500)


def test_metrics_use_complete_pairs(spark):
    m = metrics.overall(pairs(spark, (10.0, 10.0), (None, 20.0), (30.0, None)), "y", "p").first()
    assert (m.n, m.mae, m.r2) == (1, 0.0, None)
    assert metrics.overall(pairs(spark, (None, 1.0)), "y", "p").first().rmse is None
    assert metrics.overall(pairs(spark, (5.0, 5.0), (5.0, 5.0)), "y", "p").first().r2 == 1.0


def test_small_groups_are_reported_without_metrics(spark):
    rows = spark.range(64).select(F.when(F.col("id") < 29, "a").otherwise("b").alias("g"), F.col("id").cast("double").alias("y"), F.col("id").cast("double").alias("p"))
    found = {r.g: r for r in metrics.by_group(rows, "y", "p", "g").collect()}
    assert found["a"].rmse is None and found["a"].excluded_reason == "n=29 < minimum 30"
    assert found["b"].rmse == 0.0 and found["b"].n == 35


def test_selection_needs_to_beat_both_baselines(spark):
    def pick(rmse):
        rows = spark.createDataFrame([("seasonal_naive_24h", 10.0), ("seasonal_naive_168h", 8.0), *rmse.items()], "model_name string, validation_rmse double")
        return [r.model_name for r in metrics.select_model(rows, list(models.BASELINES)).collect()]
    assert pick({"ridge": 9.0, "random_forest": 7.0, "gradient_boosting": 7.5}) == ["random_forest"]
    assert pick({"ridge": 9.0}) == []


# --- models -----------------------------------------------------------------------------

def test_ridge_solves_the_penalised_sum_of_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2]
    y = x @ [2.0, -1.0, 3.0] + 7 + rng.normal(size=200)
    for alpha in (0.1, 100.0):
        rows = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", models.LABEL])
        fitted = models.ridge(rows, alpha).fit(rows)
        xc, yc = x - x.mean(axis=0), y - y.mean()
        expected = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        assert np.allclose(fitted.coefficients.toArray(), expected, rtol=1e-4)


def test_ridge_from_products_equals_direct_fits(spark):
    """All folds and penalties against numpy fits of the same prepared rows, with missing values and unseen uses."""
    rng = np.random.default_rng(5)
    n, names = 600, models._PLAIN
    x = rng.normal(size=(n, len(names))) * rng.uniform(0.1, 9, len(names)) + rng.uniform(-50, 50, len(names))
    x[:, 3] = 7.0  # a constant column
    floors = [None if rng.random() < 0.3 else float(v) for v in rng.integers(1, 9, n)]
    people = [None if rng.random() < 0.5 else float(v) for v in rng.normal(100, 30, n)]
    uses = [None if rng.random() < 0.1 else ("Office", "Lodging", "School", "Late")[3 if i > 500 else rng.integers(3)] for i in range(n)]
    y = x @ rng.normal(size=len(names)) + np.array([f or 4.0 for f in floors]) * 2 + np.array([5.0 * (u == "Office") for u in uses]) + rng.normal(size=n)
    first = datetime(2016, 1, 1)
    data = [(first + timedelta(days=i // 25), *map(float, x[i]), floors[i], people[i], uses[i], float(y[i])) for i in range(n)]
    schema = "origin_ts timestamp, " + ", ".join(f"{c} double" for c in [*names, *feat.IMPUTED]) + f", primary_use string, {models.LABEL} double"
    rows = spark.createDataFrame(data, schema).repartition(5).cache()
    best, results = models.search_alpha(rows, (0.1, 10.0, 1000.0), 3)
    assert len(results) == 9
    days = np.array([d[0] for d in data])

    def direct(train, valid, alpha):
        fill = [np.median([c[i] for i in np.flatnonzero(train) if c[i] is not None]) for c in (floors, people)]
        known = sorted({uses[i] for i in np.flatnonzero(train) if uses[i]})
        mode = min(known, key=lambda u: (-sum(uses[i] == u for i in np.flatnonzero(train)), u))
        numbers = np.column_stack([x, [fill[0] if v is None else v for v in floors], [fill[1] if v is None else v for v in people]])
        mean, spread = numbers[train].mean(axis=0), numbers[train].std(axis=0, ddof=1)
        scaled = np.where(spread > 1e-9, (numbers - mean) / np.where(spread > 1e-9, spread, 1), 0)
        full = np.column_stack([scaled, *[[float((u or mode) == k) for u in uses] for k in known]])
        a, b = full[train] - full[train].mean(axis=0), y[train] - y[train].mean()
        beta = np.linalg.solve(a.T @ a + alpha * np.eye(full.shape[1]), a.T @ b)
        guess = (full - full[train].mean(axis=0)) @ beta + y[train].mean()
        return float(np.sqrt(((y - guess)[valid] ** 2).mean())), guess

    for r in results:
        train, valid = days <= r["train_last"], (days >= r["valid_first"]) & (days <= r["valid_last"])
        assert r["rmse"] == pytest.approx(direct(train, valid, r["alpha"])[0], rel=1e-6)
    mean = {a: np.mean([r["rmse"] for r in results if r["alpha"] == a]) for a in (0.1, 10.0, 1000.0)}
    model, alpha, _ = models.fit_ridge(rows, (0.1, 10.0, 1000.0), 3)
    assert alpha == best == min(mean, key=mean.get) and set(models.known_uses(model)) == {"Office", "Lodging", "School", "Late"}
    every = np.ones(n, dtype=bool)
    got = model.transform(rows.withColumn("at", F.monotonically_increasing_id()))
    pairs = {(r["origin_ts"], r[names[0]]): r[models.OUTPUT] for r in got.collect()}
    want = direct(every, every, alpha)[1]
    assert np.allclose([pairs[d[0], d[1]] for d in data], want, rtol=1e-6)


def test_medians_of_several_columns_are_exact(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 50, 3001), rng.normal(size=3001)
    rows = spark.createDataFrame([(float(p), None if q > 1 else float(q), None) for p, q in zip(a, b)], "a double, b double, c double").repartition(6)
    medians._ORDERED, kept = 40, medians._ORDERED
    try:
        found = medians.exact_medians(rows, ["a", "b", "c"])
    finally:
        medians._ORDERED = kept
    assert found == {"a": float(np.median(a)), "b": float(np.median(b[b <= 1])), "c": None}


def test_folds_expand_in_time(spark):
    rows = spark.sql("SELECT timestamp'2016-01-01' + make_dt_interval(id) AS origin_ts, h FROM range(12) LATERAL VIEW explode(sequence(1, 24)) AS h")
    bounds = models.fold_bounds(rows, 5)
    assert len(bounds) == 5
    for b in bounds:
        assert b["train_last"] < b["valid_first"] <= b["valid_last"]
    assert [b["train_last"] for b in bounds] == sorted(b["train_last"] for b in bounds)


@pytest.fixture(scope="module")
def trained(make, spark, tmp_path_factory):
    rng = random.Random(8)
    parts = []
    for s in (1, 2, 3):
        parts.append((s, "2016-01-01", [20 * s + 8 * math.sin(2 * math.pi * h / 24) + (5 if (h // 24) % 7 < 5 else 0) + rng.gauss(0, 0.4) for h in range(24 * 40)]))
    readings = make(*parts).cache()
    static = static_of(spark, 1, 2, 3)
    periods = {"train": ("2016-01-01", "2016-01-28"), "validation": ("2016-01-28", "2016-02-03"), "test": ("2016-02-03", "2016-02-09")}
    out = str(tmp_path_factory.mktemp("train"))
    settings = jobs.Settings(trees=8, forest_depth=6, boosting_rounds=5, folds=2, alphas=(0.1, 10.0))
    result = jobs.train(spark, readings, static, periods, out, settings)
    return {"readings": readings, "static": static, "out": out, "periods": periods, **result}


def test_training_job(trained, spark):
    assert {r.model_name for r in trained["comparison"].collect()} == {"seasonal_naive_24h", "seasonal_naive_168h", "ridge", "random_forest", "gradient_boosting"}
    assert trained["selection"].count() == 1
    kept = {r.split: (r.rows_before, r.rows_after) for r in trained["retention"].collect()}
    assert kept["train"][0] == 3 * 27 * 24 and kept["validation"] == (3 * 6 * 24, 3 * 6 * 24)
    versions = {r.model_name: r for r in spark.read.parquet(f"{trained['out']}/model_versions").collect()}
    assert versions["random_forest"].artifact_path and '"rmse"' in versions["ridge"].metrics and versions["seasonal_naive_24h"].random_seed is None
    charts = report.forecast_charts(trained["metrics"])
    assert charts["model_rmse"].count() == 5 and charts["error_by_horizon"].where("model_name = 'ridge' AND split = 'test'").count() == 24


def test_prediction_and_backfill(trained, spark, tmp_path):
    name = jobs.selected_model(spark, trained["out"])
    model = jobs.load_model(f"{trained['out']}/models/{name}")
    table = feat.origins(trained["readings"], trained["static"])
    latest = jobs.predict_latest(table, trained["readings"], name, model)
    assert latest.count() == 3 * 24 and latest.where("generated_at < target_ts").count() == 72
    assert {r.horizon for r in latest.collect()} == set(range(1, 25))
    path = str(tmp_path / "predictions")
    jobs.store_predictions(spark, path, latest)
    jobs.store_predictions(spark, path, latest)
    stored = spark.read.parquet(path)
    assert stored.count() == 72
    filled = jobs.backfill(table, trained["readings"], "seasonal_naive_24h", "2016-01-20", "2016-01-21")
    assert filled.count() == 3 * 24
    view = jobs.forecast_view(spark, trained["out"], stored, trained["readings"])
    # the history ends at 23:00, so the latest day has 23 measured hours
    assert view.where("residual IS NOT NULL").count() == 3 * 23
    assert ag.forecast_screen(view).first().predictions == 72


def test_latest_day_is_searched_backwards(make, spark, tmp_path, monkeypatch):
    """Sensors that end in different months; the plan of a fresh store reads two of five."""
    static = static_of(spark, 1, 2, 3, 4)
    readings = make((1, "2016-01-01", range(24 * 140)), (2, "2016-01-01", range(24 * 75)), (3, "2016-02-20", range(24 * 20)), (4, "2016-05-01", range(24 * 3)))
    path = str(tmp_path / "energy")
    tables.upsert(spark, path, readings, schema.ENERGY, schema.ENERGY_KEY, month_of="ts")
    want = jobs.predict_latest(feat.origins(readings, static), readings, "seasonal_naive_24h")
    got = jobs.predict_latest_stored(spark, path, static, "seasonal_naive_24h")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 72
    read = []
    monkeypatch.setattr(feat, "origins", lambda r, s, *a, origins=feat.origins: read.append(r) or origins(r, s, *a))
    jobs.latest_origins(spark, path, static.where("sensor_id = 1")).collect()
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert len(read) == 1 and "PartitionFilters: [" in plan and "2016-05" in plan and "2016-03" not in plan


def test_predictions_are_read_by_folder(spark, tmp_path):
    rows = [(s, datetime(2016, m, 1, s), name, "v1", datetime(2016, m, 1), s, float(s)) for s in (1, 2) for m in (1, 2, 3) for name in ("a", "b")]
    columns = "sensor_id long, target_ts timestamp, model_name string, model_version string, generated_at timestamp, horizon int, predicted_kwh double"
    path = str(tmp_path / "predictions")
    for _ in range(2):
        jobs.store_predictions(spark, path, spark.createDataFrame(rows, columns))
    jobs.store_predictions(spark, path, spark.createDataFrame([(1, datetime(2016, 2, 1, 1), "a", "v1", datetime(2016, 2, 1), 1, 9.0)], columns))
    found = jobs.stored_predictions(spark, path, "a", start="2016-02-01", end="2016-03-01")
    assert sorted((r.sensor_id, float(r.predicted_kwh)) for r in found.collect()) == [(1, 9.0), (2, 2.0)]
    assert spark.read.parquet(path).count() == 12
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line)
    filters = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "model_name" in filters and "model_version" in filters and "month" in filters and "target_ts" in scan.split("PushedFilters: [")[1]


def test_breakdowns_from_one_scan_equal_the_single_ones(spark):
    rng = np.random.default_rng(3)
    n = 500
    rows = spark.createDataFrame(
        [(int(rng.integers(1, 25)), int(i % 9), None if i % 9 == 4 else int(i % 3), "Office" if i % 2 else None, None if i % 50 == 0 else float(rng.normal(50, 9)), float(rng.normal(50, 9)), "m" if i % 4 else "k") for i in range(n)],
        "horizon int, building_id int, site_id int, primary_use string, y double, p double, model string",
    ).cache()
    table = metrics.breakdown_table(rows, "y", "p", "model")
    assert table._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    got = {(r.model, r.breakdown, r.value): r for r in table.collect()}
    count = 0
    for r in metrics.overall(rows, "y", "p", "model").collect():
        assert (got[r.model, "overall", "all"].n, got[r.model, "overall", "all"].r2) == (r.n, pytest.approx(r.r2))
        count += 1
    for g in metrics.BREAKDOWNS:
        for r in metrics.by_group(rows, "y", "p", g, "model").collect():
            other = got[r.model, g, str(r[g])]
            assert all(other[c] == (pytest.approx(r[c]) if isinstance(r[c], float) else r[c]) for c in ("n", "mae", "rmse", "r2", "cv_rmse_pct", "excluded_reason"))
            count += 1
    assert count == len(got)


def test_no_selection_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="training job"):
        jobs.selected_model(spark, str(tmp_path))
    spark.createDataFrame([], "model_name string, validation_rmse double").write.parquet(f"{tmp_path}/selection")
    with pytest.raises(ValueError, match="no model beat"):
        jobs.selected_model(spark, str(tmp_path))


# --- companies --------------------------------------------------------------------------

def example_energy(code, start="2024-06-01 00:00:00", rows=216):
    first = datetime.fromisoformat(start)
    return [
        (code, str(first + timedelta(hours=i)), str(round(80 + 20 * math.sin(2 * math.pi * (i % 24) / 24) + (15 if (i // 24) % 7 < 5 else 0), 2)))
        for i in range(rows)
    ]


def company_frames(spark, buildings, energy):
    fields = ", ".join(f"{c} string" for c in company.FIELDS)
    return (
        spark.createDataFrame(buildings, fields),
        spark.createDataFrame(energy, "building_code string, timestamp string, energy_kwh string"),
    )


def place(code, **change):
    row = {"building_code": code, "area_sqm": "4200", "number_of_floors": "5", "occupants": "120", "primary_use": "Office", "timezone": "US/Eastern", **change}
    return tuple(row[c] for c in company.FIELDS)


def test_company_forecast(trained, spark, tmp_path):
    model = jobs.load_model(f"{trained['out']}/models/random_forest")
    buildings, energy = company_frames(spark, [place("acme"), place("moon", primary_use="Moonbase")], example_energy("acme") + example_energy("moon"))
    rows, warnings, rejections = company.forecast(buildings, energy, model)
    found = rows.where("building_code = 'acme'").orderBy("horizon").collect()
    assert [r.horizon for r in found] == list(range(1, 25)) and all(math.isfinite(r.predicted_kwh) for r in found)
    assert {str(r.generated_at) for r in found} == {"2024-06-09 04:00:00"}
    assert rejections.count() == 0
    assert [(w.building_code, "Moonbase" in w.warning) for w in warnings.collect()] == [("moon", True)]
    files.write_forecasts(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 48


def test_every_rejection_rule(spark):
    def edited(code, at, ts=None, kwh=None):
        rows = example_energy(code)
        c, t, k = rows[at]
        rows[at] = (c, t if ts is None else ts, k if kwh is None else kwh)
        return rows

    cases = {
        "blank": (place("blank", primary_use=" "), example_energy("blank"), "required_field"),
        "zone": (place("zone", timezone="Mars/Olympus"), example_energy("zone"), "timezone"),
        "words": (place("words", area_sqm="big"), example_energy("words"), "numeric_field"),
        "zero": (place("zero", occupants="0"), example_energy("zero"), "positive_field"),
        "offset": (place("offset"), edited("offset", 3, ts="2024-06-01 03:00:00Z"), "naive_timestamp"),
        "nodate": (place("nodate"), edited("nodate", 3, ts="yesterday"), "timestamp"),
        "twice": (place("twice"), edited("twice", 3, ts="2024-06-01 02:00:00"), "duplicate_timestamp"),
        "hole": (place("hole"), [r for i, r in enumerate(example_energy("hole")) if i != 100], "hourly_steps"),
        "nokwh": (place("nokwh"), edited("nokwh", 5, kwh=""), "missing_kwh"),
        "text": (place("text"), edited("text", 5, kwh="lots"), "numeric_kwh"),
        "minus": (place("minus"), edited("minus", 5, kwh="-1"), "negative_kwh"),
        "short": (place("short"), example_energy("short", rows=100), "too_few_rows"),
        "long": (place("long"), example_energy("long", rows=8761), "too_many_rows"),
        "autumn": (place("autumn"), example_energy("autumn", start="2024-11-01 00:00:00"), "ambiguous_time"),
        "spring": (place("spring"), example_energy("spring", start="2024-03-05 00:00:00"), "utc_collision"),
        "silent": (place("silent"), [], "too_few_rows"),
        "orphan": (None, example_energy("orphan"), "one_building_row"),
        "good": (place("good"), example_energy("good"), None),
    }
    buildings = [c[0] for c in cases.values() if c[0]] + [place("double"), place("double")]
    energy = [r for c in cases.values() for r in c[1]] + example_energy("double")
    static, readings, rejections = company.validate(*company_frames(spark, buildings, energy), max_rows=8760)
    found = {r.building_code: r.rule for r in rejections.collect()}
    assert found == {**{k: c[2] for k, c in cases.items() if c[2]}, "double": "one_building_row"}
    assert [r.sensor_id for r in static.collect()] == ["good"] and readings.count() == 216


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "b.csv").write_text("building_code,area_sqm\nx,1\n")
    (tmp_path / "e.csv").write_text("building_code,timestamp,energy_kwh\n")
    with pytest.raises(ValueError, match="number_of_floors"):
        files.read_companies(spark, str(tmp_path / "b.csv"), str(tmp_path / "e.csv"))
