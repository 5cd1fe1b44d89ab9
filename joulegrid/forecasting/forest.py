"""Random forest regression grown on Spark, level by level over quantised features.

Features become one byte each by quantile edges. Every tree sees every row as often as a hash of row and tree says
(Poisson draws, a bootstrap without a shuffle). While a node holds more than ``node_rows`` draws it is split by
histograms: each partition adds up draws and sums per (tree, node, feature, bin), one exchange brings a node's
histograms together, and only the chosen splits reach the driver. Rows keep their node of every tree between levels.
The rows of a node below that size, a bounded number, then go to one task, which grows the rest of its subtree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from joulegrid.session import discard, written

KEY = ["sensor_id", "origin_ts", "horizon"]
# what one pass over the rows holds in histograms, and what a task of the score holds in nodes
_HISTOGRAM_BYTES, _MODEL_BYTES = 64 << 20, 256 << 20
# nodes times bins whose splits are sought at once in a subtree: arrays that stay in a core's cache
_CELLS = 1 << 15
NODES = "tree int, node int, feature binary, threshold binary, below binary, above binary, value binary, share double"
_UP = -2  # below and above are nodes of the upper tree: twice the number, and one more


@dataclass(frozen=True)
class Shape:
    """Size of the forest; ``leaf`` counts draws."""

    trees: int = 100
    depth: int = 20
    leaf: int = 5
    seed: int = 42
    bins: int = 128
    node_rows: int = 100_000


def bin_edges(rows: DataFrame, features: Column, bins: int) -> list[np.ndarray]:
    """Per feature the distinct quantiles that may part its values: x <= edge goes below."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    width = rows.select(F.size(features)).first()[0]
    found = rows.agg(*[F.percentile_approx(features[i], shares, F.lit(10_000)).alias(f"e{i}") for i in range(width)], *[F.max(features[i]).alias(f"m{i}") for i in range(width)]).first()
    edges = [np.unique(np.array(found[f"e{i}"], dtype=float)) for i in range(width)]
    return [e[e < found[f"m{i}"]] for i, e in enumerate(edges)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


def draws(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row."""
    u = _mixed(ids ^ _mixed(np.full(1, (seed << 32) + tree + 1, dtype=np.uint64)))
    return np.searchsorted(_POISSON, u.astype(np.float64) / 2.0**64, side="right").astype(np.uint8)


def best_splits(n: np.ndarray, s: np.ndarray, histograms: Iterable[tuple[np.ndarray, np.ndarray]], leaf: int) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin, draws below, sum below) per node with ``n`` draws of sum ``s``.

    ``histograms`` are draws and sums per feature, nodes by bins, and held one at a time. The gain is the fall of
    the squared error; ties go to the first feature and bin.
    """
    nodes = len(n)
    best = [np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, dtype=np.int64), np.zeros(nodes), np.zeros(nodes)]
    every = np.arange(nodes)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.where(n > 0, s * s / n, 0.0)
        for f, (count, total) in enumerate(histograms):
            if count.shape[1] < 2:
                continue
            low, part = count[:, :-1].cumsum(axis=1), total[:, :-1].cumsum(axis=1)
            high, rest = n[:, None] - low, s[:, None] - part
            gain = part * part
            gain /= low
            rest *= rest
            rest /= high
            gain += rest
            gain -= whole[:, None]
            np.copyto(gain, -np.inf, where=np.minimum(low, high, out=high) < leaf)
            at = gain.argmax(axis=1)
            found = gain[every, at]
            better = found > best[0] * (1 + 1e-9) + 1e-9 * np.abs(whole)
            for into, value in zip(best, (found, np.full(nodes, f), at, low[every, at], part[every, at])):
                into[better] = value[better]
    return tuple(best)


def _split_some(bins: np.ndarray, w: np.ndarray, wy: np.ndarray, at: np.ndarray, n: np.ndarray, s: np.ndarray, sizes: list[int], leaf: int) -> tuple[np.ndarray, ...]:
    """:func:`best_splits` of the nodes that these rows lie ``at``; a feature of one value parts nothing, so it needs no counts."""
    nodes, none = len(n), np.zeros((len(n), 1))

    def counted(f: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        key = at * size + bins[f]
        return np.bincount(key, w, nodes * size).reshape(nodes, size), np.bincount(key, wy, nodes * size).reshape(nodes, size)

    return best_splits(n, s, (counted(f, size) if size > 1 else (none, none) for f, size in enumerate(sizes)), leaf)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, sizes: list[int], depth: int, leaf: int) -> tuple[np.ndarray, ...]:
    """(feature, bin, below, above, value) of a whole subtree over rows held in memory; ``bins`` is features by rows."""
    feature, cut, below, above, value = [-1], [0], [-1], [-1], [0.0]
    ids, at, w = np.zeros(1, dtype=np.int64), np.zeros(len(y), dtype=np.int64), w.astype(float)
    for level in range(depth + 1):
        nodes, wy = len(ids), w * y
        n, s = np.bincount(at, w, nodes), np.bincount(at, wy, nodes)
        for node, mean in zip(ids.tolist(), (s / n).tolist()):
            value[node] = mean
        large = np.flatnonzero(n >= 2 * leaf)
        if level == depth or not len(large):
            break
        place = np.full(nodes, -1)
        place[large] = np.arange(len(large))
        # rows lie node by node, in one order within a node, so a slice of them holds all rows of some nodes
        at = place[at]
        go = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
        bins, y, w, wy, at, ids, nodes = bins[:, go], y[go], w[go], wy[go], at[go], ids[large], len(large)
        split_by, split_at = np.empty(nodes, dtype=np.int64), np.empty(nodes, dtype=np.int64)
        step = max(1, _CELLS // max(sizes))
        ends = np.searchsorted(at, np.arange(0, nodes + step, step)).tolist()
        for k, (begin, end) in enumerate(zip(ends, ends[1:])):
            some = slice(k * step, min(nodes, (k + 1) * step))
            _, split_by[some], split_at[some], _, _ = _split_some(bins[:, begin:end], w[begin:end], wy[begin:end], at[begin:end] - some.start, n[large[some]], s[large[some]], sizes, leaf)
        chosen = np.flatnonzero(split_by >= 0)
        if not len(chosen):
            break
        first = len(feature)
        for k, slot in enumerate(chosen.tolist()):
            node = int(ids[slot])
            feature[node], cut[node] = int(split_by[slot]), int(split_at[slot])
            below[node], above[node] = first + 2 * k, first + 2 * k + 1
        feature += [-1] * (2 * len(chosen))
        cut += [0] * (2 * len(chosen))
        below += [-1] * (2 * len(chosen))
        above += [-1] * (2 * len(chosen))
        value += [0.0] * (2 * len(chosen))
        place = np.full(nodes, -1)
        place[chosen] = np.arange(len(chosen))
        go = place[at] >= 0
        bins, y, w, at = bins[:, go], y[go], w[go], at[go]
        high = bins[split_by[at], np.arange(len(at))] > split_at[at]
        at = 2 * place[at] + high
        ids = first + np.arange(2 * len(chosen))
    return np.array(feature, dtype=np.int16), np.array(cut), np.array(below, dtype=np.int32), np.array(above, dtype=np.int32), np.array(value)


def mapped(rows: DataFrame, schema: str, body) -> DataFrame:
    """``mapInArrow`` over batches, its body yielding dicts of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in body(batches):
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, schema)


def matrix(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    """A column of equally long binaries as rows by values."""
    values = batch.column(name).to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)


def binned(rows: DataFrame, features: Column, label: str, edges: list[np.ndarray], trees: int) -> DataFrame:
    """(id, y, bins, nodes): a row's quantised features and its node of every tree, at first the root."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)
            roots = np.ones(trees, dtype=np.int32).tobytes()
            yield {"id": batch.column("id"), "y": batch.column("y"), "bins": [b.tobytes() for b in bins], "nodes": pa.array([roots] * len(bins), pa.binary())}

    given = rows.select(F.xxhash64(*KEY).alias("id"), F.col(label).cast("double").alias("y"), features.alias("x"))
    return mapped(given, "id long, y double, bins binary, nodes binary", body)


def _histograms(state: DataFrame, open_nodes: list[tuple[int, int]], sizes: list[int], shape: Shape) -> list:
    """The best split of every open node: partial histograms per partition, one exchange by node."""
    by_tree: dict[int, np.ndarray] = {}
    for tree, node in sorted(open_nodes):
        by_tree[tree] = np.append(by_tree.get(tree, np.empty(0, dtype=np.int32)), np.int32(node))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = {t: [np.zeros((2, len(nodes), size)) for size in sizes] for t, nodes in by_tree.items()}
        seen = False
        for batch in batches:
            seen = True
            ids, y = batch.column("id").to_numpy().view(np.uint64), batch.column("y").to_numpy()
            bins, at = matrix(batch, "bins", np.uint8).T, matrix(batch, "nodes", np.int32)
            for t, nodes in by_tree.items():
                slot = np.minimum(np.searchsorted(nodes, at[:, t]), len(nodes) - 1)
                w = draws(ids, t, shape.seed) * (nodes[slot] == at[:, t])
                go = w > 0
                slots, some, weight = slot[go], bins[:, go], w[go].astype(float)
                wy = weight * y[go]
                for f, size in enumerate(sizes):
                    key = slots * size + some[f]
                    held[t][f][0] += np.bincount(key, weight, len(nodes) * size).reshape(len(nodes), size)
                    held[t][f][1] += np.bincount(key, wy, len(nodes) * size).reshape(len(nodes), size)
        if seen:
            for t, nodes in by_tree.items():
                packed = [np.concatenate([h[:, k] for h in held[t]], axis=1).tobytes() for k in range(len(nodes))]
                yield {"tree": pa.array([t] * len(nodes), pa.int32()), "node": pa.array(nodes, pa.int32()), "packed": pa.array(packed, pa.binary())}

    def split(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, dtype=float) for b in table.column("packed").to_pylist()).reshape(2, -1)
        ends = np.cumsum(sizes)[:-1]
        counts, sums = ([h[None, :] for h in np.split(row, ends)] for row in total)
        whole, mass = counts[0].sum(axis=1), sums[0].sum(axis=1)
        _, feature, cut, n, s = best_splits(whole, mass, zip(counts, sums), shape.leaf)
        return pa.table({
            "tree": table.column("tree")[:1], "node": table.column("node")[:1], "feature": pa.array(feature.astype(np.int32)), "cut": pa.array(cut.astype(np.int32)),
            "n": whole, "s": mass, "n_below": n, "s_below": s,
        })

    partial = mapped(state, "tree int, node int, packed binary", body)
    return partial.groupBy("tree", "node").applyInArrow(split, "tree int, node int, feature int, cut int, n double, s double, n_below double, s_below double").collect()


def _moved(state: DataFrame, splits: list) -> DataFrame:
    """Rows one level down: the new node of every tree whose node was split."""
    trees = sorted({r["tree"] for r in splits})
    by_tree = {t: (np.array([r["node"] for r in splits if r["tree"] == t], dtype=np.int32), [r for r in splits if r["tree"] == t]) for t in trees}
    tables = {}
    for t, (nodes, rows) in by_tree.items():
        order = np.argsort(nodes)
        tables[t] = (nodes[order], np.array([r["feature"] for r in rows])[order], np.array([r["cut"] for r in rows])[order])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            bins, at = matrix(batch, "bins", np.uint8), matrix(batch, "nodes", np.int32).copy()
            every = np.arange(len(at))
            for t, (nodes, feature, cut) in tables.items():
                slot = np.minimum(np.searchsorted(nodes, at[:, t]), len(nodes) - 1)
                hit = nodes[slot] == at[:, t]
                child = 2 * at[:, t] + (bins[every, feature[slot]] > cut[slot])
                at[:, t] = np.where(hit, child, at[:, t])
            yield {"id": batch.column("id"), "y": batch.column("y"), "bins": batch.column("bins"), "nodes": pa.array([a.tobytes() for a in at], pa.binary())}

    return mapped(state, "id long, y double, bins binary, nodes binary", body)


def _subtrees(state: DataFrame, small: list[tuple[int, int]], edges: list[np.ndarray], shape: Shape) -> DataFrame:
    """Whole subtrees of the nodes that fit into one task, as rows of :data:`NODES`."""
    wanted: dict[int, list[int]] = {}
    for tree, node in sorted(small):
        wanted.setdefault(tree, []).append(node)
    by_tree = {t: np.array(nodes, dtype=np.int32) for t, nodes in wanted.items()}
    sizes = [len(e) + 1 for e in edges]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, y = batch.column("id").to_numpy().view(np.uint64), batch.column("y").to_numpy()
            bins, at = matrix(batch, "bins", np.uint8), matrix(batch, "nodes", np.int32)
            for t, nodes in by_tree.items():
                slot = np.minimum(np.searchsorted(nodes, at[:, t]), len(nodes) - 1)
                w = draws(ids, t, shape.seed) * (nodes[slot] == at[:, t])
                go = np.flatnonzero(w)
                go = go[np.argsort(slot[go], kind="stable")]
                names, starts = np.unique(slot[go], return_index=True)
                out = {"tree": [], "node": [], "id": [], "bins": [], "y": [], "w": []}
                for k, part in zip(names.tolist(), np.split(go, starts[1:])):
                    for name, value in zip(out, (t, int(nodes[k]), ids[part].tobytes(), bins[part].tobytes(), y[part].tobytes(), w[part].tobytes())):
                        out[name].append(value)
                if out["tree"]:
                    yield {c: pa.array(v, pa.int32() if c in ("tree", "node") else pa.binary()) for c, v in out.items()}

    def subtree(table: pa.Table) -> pa.Table:
        given = table.to_pydict()
        ids, y, w = (np.frombuffer(b"".join(given[c]), dtype=kind) for c, kind in (("id", np.uint64), ("y", float), ("w", np.uint8)))
        order = np.argsort(ids, kind="stable")  # sums in one order, however rows arrived
        bins = np.frombuffer(b"".join(given["bins"]), dtype=np.uint8).reshape(len(y), -1)[order].T
        depth = shape.depth - given["node"][0].bit_length() + 1
        feature, cut, below, above, value = grow(np.ascontiguousarray(bins), y[order], w[order], sizes, depth, shape.leaf)
        threshold = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(feature.tolist(), cut.tolist())])
        return pa.table({
            "tree": table.column("tree")[:1], "node": table.column("node")[:1],
            **packed(feature, threshold, below, above, value), "share": pa.array([1.0 / shape.trees]),
        })

    parts = mapped(state, "tree int, node int, id binary, bins binary, y binary, w binary", dealt)
    return parts.groupBy("tree", "node").applyInArrow(subtree, NODES)


KINDS = {"feature": np.int16, "threshold": np.float64, "below": np.int32, "above": np.int32, "value": np.float64}


def packed(*arrays) -> dict[str, pa.Array]:
    """The flat arrays of one subtree as a row's binaries."""
    return {name: pa.array([np.asarray(a, dtype=kind).tobytes()], pa.binary()) for (name, kind), a in zip(KINDS.items(), arrays)}


def one_row(tree: int, node: int, share: float, *arrays) -> tuple:
    return tree, node, *(bytearray(np.asarray(a, dtype=kind).tobytes()) for kind, a in zip(KINDS.values(), arrays)), share


def _one(tree: int, node: int, feature: int, threshold: float, value: float, share: float) -> tuple:
    """A node of the upper tree."""
    link = [_UP if feature >= 0 else -1]
    return one_row(tree, node, share, [feature], [threshold], link, link, [value])


def grown(rows: DataFrame, features: Column, label: str, shape: Shape) -> DataFrame:
    """The forest as rows of :data:`NODES`, one for every node of an upper tree and one for every subtree."""
    spark = rows.sparkSession
    edges = bin_edges(rows, features, min(shape.bins, 256))
    sizes = [len(e) + 1 for e in edges]
    state = written(binned(rows, features, label, edges, shape.trees))
    upper: list[tuple] = []
    small: list[tuple[int, int]] = []
    large = [(t, 1) for t in range(shape.trees)] if state.count() > shape.node_rows else []
    small += [] if large else [(t, 1) for t in range(shape.trees)]
    at_once = max(1, _HISTOGRAM_BYTES // (16 * sum(sizes)))
    while large:
        found = [r for i in range(0, len(large), at_once) for r in _histograms(state, large[i : i + at_once], sizes, shape)]
        splits, next_large = [], []
        for r in found:
            whole = r["s"] / r["n"] if r["n"] else 0.0
            if r["feature"] < 0 or r["node"].bit_length() > shape.depth:
                upper.append(_one(r["tree"], r["node"], -1, 0.0, whole, 1.0 / shape.trees))
                continue
            upper.append(_one(r["tree"], r["node"], r["feature"], float(edges[r["feature"]][r["cut"]]), whole, 1.0 / shape.trees))
            splits.append(r)
            for child, n in ((2 * r["node"], r["n_below"]), (2 * r["node"] + 1, r["n"] - r["n_below"])):
                (next_large if n > shape.node_rows else small).append((r["tree"], child))
        if splits:
            down = written(_moved(state, splits))
            discard(state)
            state = down
        large = next_large
    nodes = _subtrees(state, small, edges, shape)
    if upper:
        nodes = nodes.unionByName(spark.createDataFrame(upper, NODES))
    out = written(nodes)
    discard(state)
    return out


def assembled(nodes: list) -> list[tuple[np.ndarray, ...]]:
    """Per tree flat arrays (feature, threshold, below, above, value) from collected rows of :data:`NODES`."""
    out = []
    by_tree: dict[int, list] = {}
    for r in nodes:
        by_tree.setdefault(r["tree"], []).append(r)
    for tree in sorted(by_tree):
        parts = sorted(by_tree[tree], key=lambda r: r["node"])
        arrays = [[np.frombuffer(r[c], dtype=k) * r["share"] if c == "value" else np.frombuffer(r[c], dtype=k).copy() for c, k in KINDS.items()] for r in parts]
        offset = dict(zip((r["node"] for r in parts), np.cumsum([0] + [len(a[0]) for a in arrays[:-1]]).tolist()))
        for r, (_, _, below, above, _) in zip(parts, arrays):
            if below[0] == _UP:
                below[0], above[0] = offset[2 * r["node"]], offset[2 * r["node"] + 1]
            else:
                below[below >= 0] += offset[r["node"]]
                above[above >= 0] += offset[r["node"]]
        out.append(tuple(np.concatenate(c) for c in zip(*arrays)))
    return out


def summed(x: np.ndarray, trees: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Sum of the trees' values for rows by features."""
    total, every = np.zeros(len(x)), np.arange(len(x))
    for feature, threshold, below, above, value in trees:
        at = np.zeros(len(x), dtype=np.int32)
        while True:
            f = feature[at]
            if (f < 0).all():
                break
            down = np.where(x[every, f] <= threshold[at], below[at], above[at])
            at = np.where(f < 0, at, down)
        total += value[at]
    return total


@dataclass
class Forest:
    """Fitted trees with the preprocessing in front of them; used like a fitted pipeline.

    The prediction is the sum of the trees' values, each times its share.
    """

    prepared: PipelineModel
    nodes: DataFrame
    output: str

    @property
    def stages(self) -> list:
        return self.prepared.stages

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the prediction. Trees are broadcast in blocks of bounded bytes, one pass for each."""
        sizes = {r["tree"]: r["bytes"] for r in self.nodes.groupBy("tree").agg(F.sum(F.length("feature") * 13).alias("bytes")).collect()}
        blocks, held = [[]], 0
        for tree in sorted(sizes):
            if held + sizes[tree] > _MODEL_BYTES and blocks[-1]:
                blocks, held = [*blocks, []], 0
            blocks[-1].append(tree)
            held += sizes[tree]
        names = rows.columns
        out = self.prepared.transform(rows).withColumn("_x", vector_to_array("features")).select(*names, "_x", F.lit(0.0).alias("_sum"))
        for i, block in enumerate(blocks):
            out = out.withColumn("_sum", F.col("_sum") + self._block(block)(F.col("_x")))
            out = written(out) if i + 1 < len(blocks) else out
        return out.withColumn(self.output, F.col("_sum")).drop("_x", "_sum")

    def _block(self, block: list[int]):
        known = self.nodes.sparkSession.sparkContext.broadcast(assembled(self.nodes.where(F.col("tree").isin(block)).collect()))

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(summed(np.stack(x.to_numpy()), known.value) if len(x) else [], dtype=float)

        return score

    def save(self, path: str) -> None:
        self.prepared.write().overwrite().save(f"{path}/prepared")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str, output: str) -> "Forest":
        return cls(PipelineModel.load(f"{path}/prepared"), spark.read.parquet(f"{path}/nodes"), output)


def fit(train: DataFrame, prepared: PipelineModel, label: str, output: str, shape: Shape | None = None, **sizes) -> Forest:
    """A forest over the ``features`` vector of the fitted preprocessing."""
    shape = replace(shape or Shape(), **sizes)
    rows = written(prepared.transform(train).select(*KEY, label, vector_to_array("features").alias("_x")))
    nodes = grown(rows, F.col("_x"), label, shape)
    discard(rows)
    return Forest(prepared, nodes, output)
