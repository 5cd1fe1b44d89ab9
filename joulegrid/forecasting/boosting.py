"""Gradient boosting of regression trees that grow best leaf first, from histograms added up on Spark.

Every round fits one tree to what the earlier ones leave over. The leaf whose split lowers the squared error most is
split next, until the tree has ``leaves`` leaves. A pass over the rows adds up draws and residuals per (node, feature,
bin) for the smaller children of all leaves that may still be split; the larger child is its parent minus its sibling.
So a tree costs about as many passes as it is deep; the root of the next one is its root less what the leaves' values
take from their draws. Only histograms reach the driver: a bounded number of nodes, each of
the same size. Rows lie in blocks, feature by feature, with what is left over of each; it is written anew every few rounds,
and the trees since then are taken off while rows are read. A pass follows the tree only to the nodes that it counts,
and takes the trees off those rows alone.

A tenth of the rows, by a hash of their key, is held out when there are enough of them: boosting ends once their error
has not fallen for some rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from joulegrid.forecasting.forest import KEY, NODES, Forest, best_splits, bin_edges, binned, mapped, matrix, one_row
from joulegrid.session import discard, written

# histograms of so many bytes go to the driver as they come from the partitions; more are added up by one exchange
_DIRECT_BYTES = 64 << 20
# rows of a block, and most rows of a partition of blocks, which a task may hold at once
_BLOCK_ROWS, _PART_ROWS = 1 << 15, 1 << 22
BLOCKS = "out boolean, bins binary, rest binary"


@dataclass(frozen=True)
class Shape:
    """The published defaults."""

    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    leaf: int = 20
    bins: int = 255
    hold_out_from: int = 10_000
    patience: int = 10
    tolerance: float = 1e-7
    written_every: int = 10


@dataclass
class Node:
    n: float
    s: float
    histogram: np.ndarray  # draws and sums, features one after another
    gain: float = 0.0
    feature: int = -1
    cut: int = 0
    n_below: float = 0.0
    s_below: float = 0.0
    children: tuple[int, int] | None = None  # known, whether or not the tree takes the split
    taken: bool = False


@dataclass
class Tree:
    """Nodes known so far; the first is the root. ``taken`` nodes are split in the tree."""

    sizes: list[int]
    leaf: int
    nodes: list[Node] = field(default_factory=list)

    def add(self, histograms: list[np.ndarray]) -> list[int]:
        """Nodes of these histograms, each with its best split."""
        ends = np.cumsum(self.sizes)[:-1]
        counts, sums = (np.split(np.stack([h[k] for h in histograms]), ends, axis=1) for k in (0, 1))
        n, s = counts[0].sum(axis=1), sums[0].sum(axis=1)
        found = best_splits(n, s, zip(counts, sums), self.leaf)
        first = len(self.nodes)
        for values in zip(n.tolist(), s.tolist(), histograms, *(column.tolist() for column in found)):
            self.nodes.append(Node(*values))
        return list(range(first, len(self.nodes)))

    def open(self) -> list[int]:
        """Leaves of the tree that a split would improve, best first."""
        reached, out = [0], []
        while reached:
            i = reached.pop()
            if self.nodes[i].taken:
                reached += self.nodes[i].children
            elif self.nodes[i].feature >= 0:
                out.append(i)
        return sorted(out, key=lambda i: (-self.nodes[i].gain, i))

    def leaves(self) -> int:
        return 1 + sum(node.taken for node in self.nodes)

    def take(self, most: int) -> list[int]:
        """Split best first as far as children are known; the leaves whose children are wanted next."""
        while self.leaves() < most:
            candidates = self.open()
            if not candidates:
                return []
            if self.nodes[candidates[0]].children is None:
                return [i for i in candidates[: most - self.leaves()] if self.nodes[i].children is None]
            self.nodes[candidates[0]].taken = True
        return []

    def next_root(self, rate: float) -> np.ndarray:
        """The histogram of all rows once every leaf's value is taken off its rows."""
        reached, out = [0], self.nodes[0].histogram.copy()
        while reached:
            node = self.nodes[reached.pop()]
            if node.taken:
                reached += node.children
            elif node.n:
                out[1] -= rate * node.s / node.n * node.histogram[0]
        return out

    def arrays(self, rate: float, known: bool = False) -> tuple[np.ndarray, ...]:
        """(feature, cut, below, above, value); with ``known`` every split is followed whose children are known."""
        followed = [node.children is not None if known else node.taken for node in self.nodes]
        return (
            np.array([node.feature if f else -1 for node, f in zip(self.nodes, followed)], dtype=np.int16),
            np.array([node.cut for node in self.nodes]),
            np.array([node.children[0] if f else -1 for node, f in zip(self.nodes, followed)], dtype=np.int32),
            np.array([node.children[1] if f else -1 for node, f in zip(self.nodes, followed)], dtype=np.int32),
            np.array([rate * node.s / node.n if node.n else 0.0 for node in self.nodes]),
        )


def _paths(tree: tuple[np.ndarray, ...], nodes: list[int]) -> set[int]:
    """The nodes on the way to ``nodes``, themselves included."""
    up = {int(child): node for node, f in enumerate(tree[0]) if f >= 0 for child in (tree[2][node], tree[3][node])}
    out: set[int] = set()
    for node in nodes:
        while node is not None and node not in out:
            out.add(node)
            node = up.get(node)
    return out


def _parted(bins: np.ndarray, tree: tuple[np.ndarray, ...], on: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(node, rows) of the nodes at which rows end; ``bins`` is features by rows, ``on`` the nodes to follow."""
    feature, cut, below, above = tree[:4]
    stack = [(0, np.arange(bins.shape[1]))]
    while stack:
        node, rows = stack.pop()
        if feature[node] < 0:
            yield node, rows
            continue
        high = bins[feature[node]][rows] > cut[node]
        for child, side in ((int(below[node]), ~high), (int(above[node]), high)):
            if on is None or child in on:
                stack.append((child, rows[side]))


def _take_off(rest: np.ndarray, bins: np.ndarray, recent: list[tuple]) -> None:
    for one in recent:
        for node, rows in _parted(bins, one):
            rest[rows] -= one[4][node]


def held_out(ids: np.ndarray) -> np.ndarray:
    """Whether a row's key puts it into the tenth that is not fitted."""
    return (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) < np.uint64((1 << 32) // 10)


def _blocks(rows: DataFrame, hold_out: bool) -> DataFrame:
    """Rows of (id, y, bins) in blocks, feature by feature; those held out have blocks of their own."""

    def block(out: bool, held: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        bins, y = (np.concatenate(part) for part in zip(*held))
        return {"out": [out], "bins": pa.array([np.ascontiguousarray(bins.T).tobytes()], pa.binary()), "rest": pa.array([y.tobytes()], pa.binary())}

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            bins, y = matrix(batch, "bins", np.uint8), batch.column("y").to_numpy()
            apart = held_out(batch.column("id").to_numpy().view(np.uint64)) if hold_out else np.zeros(len(y), dtype=bool)
            for out, parts in held.items():
                parts.append((bins[apart == out], y[apart == out]))
                if sum(len(part[1]) for part in parts) >= _BLOCK_ROWS:
                    yield block(out, parts)
                    parts.clear()
        for out, parts in held.items():
            if any(len(part[1]) for part in parts):
                yield block(out, parts)

    return mapped(rows, BLOCKS, body)


def _each(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(held out, bins as features by rows, what is left over) of every block."""
    for batch in batches:
        for out, bins, rest in zip(*(batch.column(name) for name in ("out", "bins", "rest"))):
            yield out.as_py(), np.frombuffer(bins.as_buffer(), dtype=np.uint8).reshape(features, -1), np.frombuffer(rest.as_buffer())


def _pass(state: DataFrame, recent: list[tuple], tree: tuple | None, wanted: list[tuple[int, int, int]], sizes: list[int], parts: int, judged: bool = False) -> tuple[dict[int, np.ndarray], float, int]:
    """Histograms of new nodes (name, parent, feature and cut by the parent's arrays), and, if ``judged``, held-out error and rows.

    ``wanted`` lists (name, parent, side): the rows of ``parent`` that its best split sends below (0) or above (1);
    parent -1 is all rows.
    """
    width, nodes = sum(sizes), len(wanted)
    starts = np.cumsum([0, *sizes]).tolist()
    sides = {parent: (k, side) for k, (_, parent, side) in enumerate(wanted)}
    on = _paths(tree, list(sides)) if tree is not None else None

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = np.zeros((nodes, 2, width))
        error, rows = 0.0, 0
        for out, bins, rest in _each(batches, len(sizes)):
            if out:
                if judged:
                    y = rest.copy()
                    _take_off(y, bins, recent)
                    error, rows = error + float((y**2).sum()), rows + len(y)
                continue
            if tree is None:
                some, y, slot = bins, rest.copy(), 0
            else:
                go: list = [None] * nodes
                for node, at in _parted(bins, tree, on):
                    k, side = sides[node]
                    go[k] = at[(bins[tree[5][node]][at] > tree[1][node]) == side]
                slot, at = np.repeat(np.arange(nodes), [len(g) for g in go]), np.concatenate(go)
                some, y = bins[:, at], rest[at]
            _take_off(y, some, recent)
            for f, size in enumerate(sizes):
                key, to = slot * size + some[f], slice(starts[f], starts[f + 1])
                held[:, 0, to] += np.bincount(key, minlength=nodes * size).reshape(nodes, size)
                held[:, 1, to] += np.bincount(key, y, nodes * size).reshape(nodes, size)
        yield {
            "name": pa.array([w[0] for w in wanted] + [-1], pa.int32()),
            "packed": pa.array([h.tobytes() for h in held] + [np.array([error, rows], dtype=float).tobytes()], pa.binary()),
        }

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table.column("packed").to_pylist())
        return pa.table({"name": table.column("name")[:1], "packed": pa.array([total.tobytes()], pa.binary())})

    found = mapped(state, "name int, packed binary", body)
    if parts * nodes * width * 16 > _DIRECT_BYTES:
        found = found.groupBy("name").applyInArrow(added, "name int, packed binary")
    sums: dict[int, np.ndarray] = {}
    got = found.toArrow()
    for name, blob in zip(got.column("name").to_pylist(), got.column("packed").to_pylist()):
        sums[name] = sums.get(name, 0) + np.frombuffer(blob)
    error, rows = sums.pop(-1, np.zeros(2))
    return {name: total.reshape(2, width) for name, total in sums.items()}, float(error), int(rows)


def _left_over(state: DataFrame, recent: list[tuple], features: int) -> DataFrame:
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for out, bins, rest in _each(batches, features):
            y = rest.copy()
            _take_off(y, bins, recent)
            yield {"out": [out], "bins": pa.array([bins.tobytes()], pa.binary()), "rest": pa.array([y.tobytes()], pa.binary())}

    return mapped(state, BLOCKS, body)


def boosted(rows: DataFrame, features, label: str, shape: Shape) -> tuple[list[tuple], float]:
    """The trees as (feature, threshold, below, above, value) and the value that they start from."""
    edges = bin_edges(rows, features, min(shape.bins, 256))
    sizes = [len(e) + 1 for e in edges]
    count = rows.count()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // _PART_ROWS))
    state = written(_blocks(binned(rows, features, label, edges, 0).drop("nodes").repartition(parts, "id"), count > shape.hold_out_from))
    begin, _, _ = _pass(state, [], None, [(0, -1, 0)], sizes, parts)
    n, s = begin[0][0, : sizes[0]].sum(), begin[0][1, : sizes[0]].sum()
    base = float(s / n) if n else 0.0
    recent: list[tuple] = [_leaf(base)]
    trees: list[Tree] = []
    best, since, root = np.inf, 0, None
    for _ in range(shape.rounds):
        tree = Tree(sizes, shape.leaf)
        if root is None:
            found, _, _ = _pass(state, recent, None, [(0, -1, 0)], sizes, parts)
            root = found[0]
        tree.add([root])
        error, rows_out = 0.0, 0
        while wanted := tree.take(shape.leaves):
            # every pass of a round would see the same held-out error, so the first one adds it up
            first = len(tree.nodes) == 1
            judged = _grow(tree, wanted, state, recent, sizes, parts, first)
            error, rows_out = judged if first else (error, rows_out)
        if rows_out:
            if error / rows_out < best - shape.tolerance:
                best, since = error / rows_out, 0
            else:
                since += 1
            if since >= shape.patience:
                break
        if tree.leaves() == 1:
            break
        trees.append(tree)
        recent.append(tree.arrays(shape.rate))
        root = tree.next_root(shape.rate)
        if len(recent) > shape.written_every:
            fresh = written(_left_over(state, recent, len(sizes)))
            discard(state)
            state, recent, root = fresh, [], None
    discard(state)
    return [_thresholds(t.arrays(shape.rate), edges) for t in trees], base


def _leaf(value: float) -> tuple[np.ndarray, ...]:
    return np.array([-1], dtype=np.int16), np.zeros(1, dtype=int), np.array([-1], dtype=np.int32), np.array([-1], dtype=np.int32), np.array([value])


def _grow(tree: Tree, wanted: list[int], state: DataFrame, recent: list[tuple], sizes: list[int], parts: int, judged: bool) -> tuple[float, int]:
    """Children of the wanted leaves: the smaller one is counted, its sibling is the rest of the parent.

    Returns, if ``judged``, the held-out error before this tree, and the rows behind it.
    """
    arrays = (*tree.arrays(1.0, known=True), np.array([node.feature for node in tree.nodes]))
    asked = []
    for i in wanted:
        node = tree.nodes[i]
        asked.append((i, i, 0 if node.n_below <= node.n - node.n_below else 1))
    found, error, rows = _pass(state, recent, arrays, asked, sizes, parts, judged)
    pairs = [(found[i], tree.nodes[i].histogram - found[i])[:: -1 if side else 1] for i, _, side in asked]
    children = tree.add([histogram for pair in pairs for histogram in pair])
    for k, i in enumerate(wanted):
        tree.nodes[i].children = (children[2 * k], children[2 * k + 1])
    return error, rows


def _thresholds(tree: tuple[np.ndarray, ...], edges: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The tree over features instead of bins; nodes that it does not reach go."""
    feature, cut, below, above, value = tree
    order, i = [0], 0
    while i < len(order):
        if feature[order[i]] >= 0:
            order += [int(below[order[i]]), int(above[order[i]])]
        i += 1
    place = {node: k for k, node in enumerate(order)}
    limits = [float(edges[feature[v]][cut[v]]) if feature[v] >= 0 else 0.0 for v in order]
    down, up = ([place[int(side[v])] if feature[v] >= 0 else -1 for v in order] for side in (below, above))
    return feature[order], np.array(limits), np.array(down, dtype=np.int32), np.array(up, dtype=np.int32), value[order]


def fit(train: DataFrame, prepared: PipelineModel, label: str, output: str, shape: Shape | None = None, **sizes) -> Forest:
    """Boosted trees over the ``features`` vector of the fitted preprocessing."""
    rows = written(prepared.transform(train).select(*KEY, label, vector_to_array("features").alias("_x")))
    trees, base = boosted(rows, F.col("_x"), label, replace(shape or Shape(), **sizes))
    discard(rows)
    start = one_row(0, 1, 1.0, [-1], [0.0], [-1], [-1], [base])
    table = [start, *[one_row(i + 1, 1, 1.0, *tree) for i, tree in enumerate(trees)]]
    # a bounded number of nodes per round
    return Forest(prepared, written(train.sparkSession.createDataFrame(table, NODES)), output)
