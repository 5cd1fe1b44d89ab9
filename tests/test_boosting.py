"""Boosting against a plain version that looks at every split of every leaf."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from joulegrid.forecasting import boosting, forest
from test_forest import predictions, table


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark, 3000, 4).repartition(5).cache()


@pytest.fixture(scope="module")
def prepared(rows):
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features")]).fit(rows)


def brute(x, y, edges, rounds, leaves, leaf, rate):
    """Predictions of boosted trees grown best leaf first."""
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    out = np.full(len(y), y.mean())

    def best(go, rest):
        found = (1e-9, None)
        s, n = rest[go].sum(), go.sum()
        for f, e in enumerate(edges):
            for c in range(len(e)):
                low = go & (bins[:, f] <= c)
                k = low.sum()
                if k < leaf or n - k < leaf:
                    continue
                part = rest[low].sum()
                gain = part**2 / k + (s - part) ** 2 / (n - k) - s**2 / n
                if gain > found[0] * (1 + 1e-9):
                    found = (gain, (f, c))
        return found

    for _ in range(rounds):
        rest = y - out
        parts = [np.ones(len(y), dtype=bool)]
        gains = [best(parts[0], rest)]
        while len(parts) < leaves:
            k = max(range(len(parts)), key=lambda i: gains[i][0] if gains[i][1] else -1)
            if not gains[k][1]:
                break
            f, c = gains[k][1]
            go = parts.pop(k)
            gains.pop(k)
            for side in (go & (bins[:, f] <= c), go & (bins[:, f] > c)):
                parts.append(side)
                gains.append(best(side, rest))
        for go in parts:
            out[go] += rate * rest[go].mean()
    return out


@pytest.mark.parametrize("direct", [64 << 20, 0])
def test_trees_equal_the_plain_version(rows, prepared, direct, monkeypatch):
    """Histograms straight to the driver or through one exchange; predictions written anew after two rounds."""
    monkeypatch.setattr(boosting, "_DIRECT_BYTES", direct)
    model = boosting.fit(rows, prepared, "y", "p", rounds=4, leaves=9, bins=32, written_every=1)
    given = rows.orderBy("sensor_id").collect()
    x, y = np.array([[r[c] for c in "abcd"] for r in given]), np.array([r["y"] for r in given])
    edges = forest.bin_edges(rows, F.array("a", "b", "c", "d"), 32)
    assert np.allclose(predictions(model, rows), brute(x, y, edges, 4, 9, 20, 0.1), rtol=1e-9)


def test_published_sizes_and_held_out_error(spark, rows, prepared, tmp_path):
    model = boosting.fit(rows, prepared, "y", "p", rounds=25)
    trees = forest.assembled(model.nodes.where("tree > 0").collect())
    assert len(trees) == 25 and all((t[0] < 0).sum() == 31 for t in trees)
    fresh = table(spark, 1000, 9)
    y = np.array([r["y"] for r in fresh.orderBy("sensor_id").collect()])
    p = predictions(model, fresh)
    assert 1 - ((y - p) ** 2).mean() / y.var() > 0.95
    model.save(str(tmp_path / "m"))
    assert (predictions(forest.Forest.load(spark, str(tmp_path / "m"), "p"), fresh) == p).all()


def test_it_ends_when_held_out_rows_stop_improving(spark, prepared):
    rng = np.random.default_rng(2)
    noise = spark.createDataFrame([(i, i, 1, *map(float, rng.normal(size=5))) for i in range(1200)], "sensor_id long, origin_ts long, horizon int, a double, b double, c double, d double, y double")
    model = boosting.fit(noise, prepared, "y", "p", hold_out_from=1000, patience=3, leaves=5)
    assert model.nodes.count() - 1 < 40


def test_a_constant_label_needs_no_tree(spark, prepared):
    flat = spark.createDataFrame([(i, i, 1, float(i), 0.0, 0.0, 0.0, 5.0) for i in range(60)], "sensor_id long, origin_ts long, horizon int, a double, b double, c double, d double, y double")
    model = boosting.fit(flat, prepared, "y", "p")
    assert model.nodes.count() == 1 and set(predictions(model, flat)) == {5.0}


def test_blocks_hold_every_row_once_and_a_pass_follows_only_what_it_counts(spark):
    """State lies in blocks; rows held out have their own, and only the asked paths of a tree are walked."""
    rng = np.random.default_rng(5)
    ids, bins, y = np.arange(500, dtype=np.int64) * 7919, rng.integers(0, 9, (500, 3)).astype(np.uint8), rng.normal(size=500)
    given = spark.createDataFrame([(int(i), float(v), bytearray(b.tobytes())) for i, v, b in zip(ids, y, bins)], "id long, y double, bins binary").repartition(3)
    seen = {False: [], True: []}
    for r in boosting._blocks(given, True).collect():
        block, rest = np.frombuffer(r["bins"], dtype=np.uint8).reshape(3, -1), np.frombuffer(r["rest"])
        seen[r["out"]] += [(float(v), *b) for v, b in zip(rest, block.T.tolist())]
    apart = boosting.held_out(ids.view(np.uint64))
    for out, found in seen.items():
        assert sorted(found) == sorted((float(v), *b) for v, b in zip(y[apart == out], bins[apart == out].tolist()))
    tree = (np.array([0, 1, -1, -1, -1]), np.array([4, 2, 0, 0, 0]), np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]))
    walked = dict(boosting._parted(bins.T, tree, boosting._paths(tree, [3])))
    assert list(walked) == [3] and walked[3].tolist() == np.flatnonzero((bins[:, 0] <= 4) & (bins[:, 1] <= 2)).tolist()
    assert sorted(np.concatenate([rows for _, rows in boosting._parted(bins.T, tree)]).tolist()) == list(range(500))
