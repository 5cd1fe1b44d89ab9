"""The random forest: distributed levels against one task, an exhaustive split search, and what it learns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from joulegrid.forecasting import forest


def table(spark, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.exponential(size=n), np.ones(n)])
    y = np.where(x[:, 0] > 0.3, 4.0, -2.0) * (x[:, 1] + 1) + x[:, 2] ** 2 + rng.normal(scale=0.1, size=n)
    rows = [(i, i % 7, 1, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "sensor_id long, origin_ts long, horizon int, a double, b double, c double, d double, y double")


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark).repartition(6).cache()


@pytest.fixture(scope="module")
def prepared(rows):
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features")]).fit(rows)


def predictions(model, rows):
    return np.array([r["p"] for r in model.transform(rows).orderBy("sensor_id").select("p").collect()])


def test_levels_on_the_cluster_equal_one_task(rows, prepared):
    sizes = {"trees": 6, "depth": 9, "leaf": 5}
    whole = forest.fit(rows, prepared, "y", "p", **sizes)
    parted = forest.fit(rows, prepared, "y", "p", node_rows=300, **sizes)
    assert whole.nodes.count() == 6 < parted.nodes.count()
    assert np.allclose(predictions(whole, rows), predictions(parted, rows), rtol=1e-9)
    again = forest.fit(rows.repartition(3), prepared, "y", "p", **sizes)
    assert np.allclose(predictions(whole, rows), predictions(again, rows), rtol=1e-9)


def test_every_split_is_the_best_one():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 6, (3, 200)).astype(np.uint8)
    y, w = bins[0] * 2.0 + rng.normal(size=200), rng.integers(1, 4, 200).astype(np.uint8)
    feature, cut, below, above, value = forest.grow(bins, y, w, [6, 6, 6], 4, 5)

    def error(go):
        return float((w[go] * (y[go] - np.average(y[go], weights=w[go])) ** 2).sum()) if go.any() else 0.0

    def walk(node, go, depth):
        assert value[node] == pytest.approx(np.average(y[go], weights=w[go]))
        options = [
            (error(go & (bins[f] <= c)) + error(go & (bins[f] > c)), f, c)
            for f in range(3) for c in range(5) if min(w[go & (bins[f] <= c)].sum(), w[go & (bins[f] > c)].sum()) >= 5
        ]
        if feature[node] < 0:
            assert depth == 4 or not options or min(options)[0] >= error(go) - 1e-6
            return
        best = error(go & (bins[feature[node]] <= cut[node])) + error(go & (bins[feature[node]] > cut[node]))
        assert best == pytest.approx(min(options)[0])
        walk(below[node], go & (bins[feature[node]] <= cut[node]), depth + 1)
        walk(above[node], go & (bins[feature[node]] > cut[node]), depth + 1)

    walk(0, np.ones(200, dtype=bool), 0)


def test_draws_are_a_bootstrap():
    ids = np.arange(200_000, dtype=np.uint64)
    one, other = forest.draws(ids, 1, 42), forest.draws(ids, 2, 42)
    assert abs(one.mean() - 1) < 0.01 and abs(one.var() - 1) < 0.02 and abs((one == 0).mean() - 0.3679) < 0.005
    assert abs(np.corrcoef(one, other)[0, 1]) < 0.01 and (one == forest.draws(ids, 1, 42)).all()


def test_held_out_error_and_a_stored_model(spark, rows, prepared, tmp_path):
    model = forest.fit(rows, prepared, "y", "p", trees=20, depth=12)
    fresh = table(spark, 1000, 9)
    y = np.array([r["y"] for r in fresh.orderBy("sensor_id").collect()])
    p = predictions(model, fresh)
    assert 1 - ((y - p) ** 2).mean() / y.var() > 0.97
    model.save(str(tmp_path / "m"))
    assert (predictions(forest.Forest.load(spark, str(tmp_path / "m"), "p"), fresh) == p).all()
    forest._MODEL_BYTES, kept = 2000, forest._MODEL_BYTES
    try:
        assert np.allclose(predictions(model, fresh), p)  # trees in several blocks
    finally:
        forest._MODEL_BYTES = kept


def test_edges_part_the_values(rows):
    edges = forest.bin_edges(rows, F.array("a", "b", "c", "d"), 16)
    assert edges[1].tolist() == [0.0, 1.0, 2.0, 3.0] and len(edges[3]) == 0 and len(edges[0]) == 15
