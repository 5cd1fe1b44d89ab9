"""Ridge regression and its penalty search from summed products.

The products of all columns are added up per time block in one scan. Every expanding window is a sum of blocks, and
filling, scaling and coding of its training rows are linear in the columns, so all fits and their validation errors
are small systems solved from the same sums; no window is read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexerModel
from pyspark.sql import Column, DataFrame, functions as F

from joulegrid.functions.medians import exact_percentiles_of


@dataclass
class Products:
    """Sums of products per block of the columns 1, numbers, per filled column its value (0 where missing) and whether
    it is missing, one flag per use, one for a missing use, and the label. ``block`` -1 holds rows of no block."""

    numbers: list[str]
    filled: list[str]
    uses: list[str]
    sums: dict[int, np.ndarray]
    medians: dict[int, list[float]]  # of the filled columns over the blocks up to this one

    @property
    def names(self) -> list[str]:
        pairs = [x for c in self.filled for x in (c, f"missing {c}")]
        return ["1", *self.numbers, *pairs, *[f"use {u}" for u in self.uses], "no use", "label"]

    def upto(self, block: int) -> np.ndarray:
        return sum((g for b, g in self.sums.items() if 0 <= b <= block), np.zeros((len(self.names),) * 2))


def _columns(numbers: list[str], filled: list[str], use: str, uses: list[str], label: str) -> list[Column]:
    def number(x: Column) -> Column:
        return x.cast("double")

    out = [F.lit(1.0), *[number(F.col(c)) for c in numbers]]
    for c in filled:
        out += [F.coalesce(number(F.col(c)), F.lit(0.0)), number(F.col(c).isNull())]
    out += [number(F.coalesce(F.col(use) == u, F.lit(False))) for u in uses]
    return [*out, number(F.col(use).isNull()), number(F.col(label))]


def products(rows: DataFrame, block: Column, numbers: list[str], filled: list[str], use: str, label: str, blocks: int) -> Products:
    """One scan for the sums and a few narrow ones for the medians. Numbers and label have no NULL; ``block`` is 0, 1, ..."""
    uses = sorted(r[0] for r in rows.where(F.col(use).isNotNull()).select(use).distinct().collect())  # one per kind of building
    medians = exact_percentiles_of(rows, [(F.when(block <= b, F.col(c)), 50) for b in range(blocks) for c in filled])
    table = summed_products(rows.select(F.coalesce(block, F.lit(-1)).cast("int").alias("block"), F.array(*_columns(numbers, filled, use, uses, label)).alias("z")))
    width = len(numbers) + 2 * len(filled) + len(uses) + 3
    sums = {r["block"]: np.frombuffer(r["packed"]).reshape(width, width) for r in table.collect()}
    found = {b: [m if m is not None else 0.0 for m in medians[b * len(filled) : (b + 1) * len(filled)]] for b in range(blocks)}
    return Products(numbers, filled, uses, sums, found)


def summed_products(rows: DataFrame) -> DataFrame:
    """(block, packed): the matrix of summed products of ``z`` per block; partitions add up before the exchange."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(len(blocks), -1)
            for b in np.unique(blocks).tolist():
                part = z[blocks == b]
                held[b] = held.get(b, 0) + part.T @ part
        if held:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(held), pa.int32()), "packed": [g.tobytes() for g in held.values()]})

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table.column("packed").to_pylist())
        return pa.table({"block": table.column("block")[:1], "packed": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, packed binary"
    return rows.mapInArrow(partial, schema).groupBy("block").applyInArrow(added, schema)


@dataclass
class Fit:
    """Weights of the columns of :class:`Products`; the mode stands in for a missing use, the median for a missing value."""

    weights: np.ndarray
    uses: list[str]
    mode: str | None
    medians: list[float]


def _features(p: Products, gram: np.ndarray, medians: list[float]) -> tuple[np.ndarray, list[str], str | None]:
    """Rows of a matrix from columns to features: 1, scaled numbers, known uses."""
    names, n = p.names, gram[0, 0]
    at = {name: i for i, name in enumerate(names)}
    rows = []
    for c in [*p.numbers, *p.filled]:
        row = np.zeros(len(names))
        row[at[c]] = 1.0
        if c in p.filled:
            row[at[f"missing {c}"]] = medians[p.filled.index(c)]
        mean = row @ gram[:, 0] / n
        row[0] -= mean
        spread = np.sqrt(max(row @ gram @ row, 0.0) / max(n - 1, 1))
        rows.append(row / spread if spread > 1e-12 * max(1.0, abs(mean)) else np.zeros(len(names)))
    counts = {u: gram[at[f"use {u}"], 0] for u in p.uses}
    known = [u for u in p.uses if counts[u] > 0]
    mode = min(known, key=lambda u: (-counts[u], u)) if known else None
    for u in known:
        row = np.zeros(len(names))
        row[at[f"use {u}"]] = 1.0
        if u == mode:
            row[at["no use"]] = 1.0
        rows.append(row)
    one = np.zeros(len(names))
    one[0] = 1.0
    return np.vstack([one, *rows]), known, mode


def solve(p: Products, block: int, alpha: float) -> Fit:
    """Ridge over the blocks up to ``block``: penalty alpha on the sum of squares, none on the intercept."""
    gram, medians = p.upto(block), p.medians[block]
    to, known, mode = _features(p, gram, medians)
    # centred, so that large means cost no digits
    means = to @ gram[:, 0] / gram[0, 0]
    centred = to.copy()
    centred[1:, 0] -= means[1:]
    x, label = centred[1:], np.eye(len(p.names))[-1]
    label[0] = -gram[-1, 0] / gram[0, 0]
    beta = np.linalg.lstsq(x @ gram @ x.T + alpha * np.eye(len(x)), x @ gram @ label, rcond=None)[0]
    weights = beta @ x
    weights[0] += gram[-1, 0] / gram[0, 0]
    return Fit(weights, known, mode, medians)


def squared_error(fit: Fit, gram: np.ndarray) -> float:
    """Sum of squared errors of a fit over the rows behind ``gram``."""
    miss = -fit.weights.copy()
    miss[-1] += 1.0
    return float(max(miss @ gram @ miss, 0.0))


def search(p: Products, alphas: tuple[float, ...], folds: int) -> list[tuple[int, float, float]]:
    """(fold, alpha, validation RMSE): fold k is fitted on the blocks up to k and checked on the next."""
    out = []
    for k in range(folds):
        after = p.sums.get(k + 1)
        for alpha in alphas:
            rmse = np.sqrt(squared_error(solve(p, k, alpha), after) / after[0, 0]) if after is not None and after[0, 0] else None
            out.append((k, alpha, float(rmse) if rmse is not None else None))
    return out


def model(p: Products, fit: Fit, use: str, output: str) -> PipelineModel:
    """The fit as a pipeline: a weighted sum in SQL. Its first stage names the uses it knows."""
    weight = dict(zip(p.names, fit.weights.tolist()))
    terms = [repr(weight["1"]) + "D", *[f"{weight[c]!r}D * cast(`{c}` as double)" for c in p.numbers]]
    terms += [f"{weight[c]!r}D * coalesce(cast(`{c}` as double), {m!r}D)" for c, m in zip(p.filled, fit.medians)]

    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    if fit.uses:
        cases = " ".join(f"WHEN {text(u)} THEN {weight[f'use {u}']!r}D" for u in fit.uses)
        terms.append(f"CASE coalesce(`{use}`, {text(fit.mode)}) {cases} ELSE 0D END")
    names = StringIndexerModel.from_labels(fit.uses or [""], inputCol=use, outputCol="use_index", handleInvalid="keep")
    return PipelineModel(stages=[names, SQLTransformer(statement=f"SELECT * EXCEPT (use_index), {' + '.join(terms)} AS {output} FROM __THIS__")])
