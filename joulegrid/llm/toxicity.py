"""Toxicity severity by cumulative-link (proportional odds) regression on sparse text features.

``P(grade > k) = sigmoid(w x - theta_k)``: one weight vector shared by all thresholds, thresholds in order.
Features are words and word beginnings of four to seven letters, present or not, chosen by their association
with toxic labels; a document's value is the logarithm of how often a feature stands in a hundred words.
The output is the expected grade. Only a bounded, documented sample of labelled rows is used for the fit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from joulegrid.llm.common import arrow_rows, labelled, stored, texts

SAMPLE_ROWS = 20_000  # bound of the labelled rows a fit reads
VOCABULARY = 2_000  # bound of the features
FEWEST_DOCS = 3
GRADES = 4
_WORD = re.compile(r"[^\W_]+")
_CACHE = 200_000


def word_features(word: str) -> list[str]:
    """The word and its beginnings of four to seven letters, marked as such."""
    return [word, *[word[:k] + "*" for k in range(4, min(7, len(word) - 1) + 1)]]


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    thetas: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) per row and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thetas[None, :], -40, 40)))


def counts(text: str, features: dict[str, int], cache: dict[str, tuple[int, ...]]) -> tuple[dict[int, int], int]:
    """How often each chosen feature stands in the text, and the number of words."""
    words = _WORD.findall(text.lower())
    found: dict[int, int] = {}
    for word in words:
        ids = cache.get(word)
        if ids is None:
            if len(cache) > _CACHE:
                cache.clear()
            ids = cache[word] = tuple(features[f] for f in word_features(word) if f in features)
        for i in ids:
            found[i] = found.get(i, 0) + 1
    return found, len(words)


def values(found: dict[int, int], words: int) -> tuple[list[int], list[float]]:
    return list(found), [float(np.log1p(100.0 * n / words)) for n in found.values()]


def fit_cumulative(ids: list[list[int]], xs: list[list[float]], grade: np.ndarray, width: int, grades: int, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam on the penalised likelihood."""
    row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    col = np.array([i for r in ids for i in r], dtype=np.int64)
    val = np.array([v for r in xs for v in r])
    # thresholds as a first one and positive steps keep their order
    share = [np.clip((grade > k).mean(), 1e-4, 1 - 1e-4) for k in range(grades - 1)]
    start = np.array([np.log((1 - p) / p) for p in share])
    params = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    n = np.arange(len(grade))
    for t in range(1, rounds + 1):
        w, steps = params[:width], np.exp(params[width + 1 :])
        theta = params[width] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(row, weights=w[col] * val, minlength=len(grade))
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = sigmoid(bounds[grade + 1] - score), sigmoid(bounds[grade] - score)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        dscore = du - dl  # of the negative log-likelihood
        dtheta = np.zeros((len(grade), grades + 1))
        dtheta[n, grade + 1] -= du
        dtheta[n, grade] += dl
        dtheta = dtheta.mean(0)[1:-1]
        gradient = np.concatenate([
            np.bincount(col, weights=dscore[row] * val, minlength=width) / len(grade) + ridge * w,
            [dtheta.sum()], steps * np.cumsum(dtheta[::-1])[::-1][1:],
        ])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:width], params[width] + np.concatenate([[0.0], np.cumsum(np.exp(params[width + 1 :]))])


def chosen_features(sample: DataFrame, vocabulary: int = VOCABULARY) -> dict[str, int]:
    """The features most associated with toxic documents: highest log-odds among those toxic documents share."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows: Counter[tuple[str, bool]] = Counter()
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
                words = set(_WORD.findall(text.lower()))
                rows.update((f, toxic > 0) for f in {f for w in words for f in word_features(w)})
            yield {"feature": [k[0] for k in rows], "toxic": [n if k[1] else 0 for k, n in rows.items()], "clean": [0 if k[1] else n for k, n in rows.items()]}

    seen = arrow_rows(sample.select("text", "toxic"), "feature string, toxic long, clean long", body)
    totals = sample.agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    toxic, clean = F.sum("toxic"), F.sum("clean")
    odds = F.log((toxic + 0.5) / float(totals["t"] + 1)) - F.log((clean + 0.5) / float(totals["c"] + 1))
    ranked = seen.groupBy("feature").agg(toxic.alias("n"), (odds * F.sqrt(toxic)).alias("weight"), odds.alias("odds"))
    best = ranked.where((F.col("n") >= FEWEST_DOCS) & (F.col("odds") > 2.0)).orderBy(F.desc("weight"), "feature").limit(vocabulary)
    return {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}


def graded(toxic: np.ndarray, density: np.ndarray, grades: int) -> np.ndarray:
    """Severity grades from yes-or-no labels: 0 if clean, 1.. by the quantile of a toxic text's feature density."""
    grade = np.zeros(len(toxic), dtype=np.int64)
    if (toxic > 0).any():
        cuts = np.quantile(density[toxic > 0], [k / (grades - 1) for k in range(1, grades - 1)])
        grade[toxic > 0] = 1 + np.searchsorted(cuts, density[toxic > 0], side="left")
    return grade


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", grades: int = GRADES, bound: int = SAMPLE_ROWS, grade: str | None = None) -> Model:
    """Fit on at most ``bound`` labelled documents.

    ``grade`` names a column of ``labels`` with severities 0 .. grades-1; rows whose grade is NULL or outside are not
    used. Without one, ``label`` says toxic or
    not and the grade of toxic rows follows from how dense toxic features are in them.
    """
    columns = [F.col(label).cast("int").alias("toxic"), (F.col(grade).cast("int") if grade else F.lit(None).cast("int")).alias("grade")]
    known = labels.select(F.col("doc_id").cast("long"), *columns).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(F.col("grade").between(0, grades - 1)) if grade else known
    sample = stored(labelled(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), known, bound))
    features = chosen_features(sample)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            made = [values(*counts(t, features, cache)) for t in texts(batch)]
            yield {"toxic": batch.column("toxic"), "grade": batch.column("grade"), "ids": [m[0] for m in made], "xs": [m[1] for m in made]}

    rows = arrow_rows(sample.select("text", "toxic", "grade"), "toxic int, grade int, ids array<int>, xs array<double>", body).toPandas()
    toxic = rows["toxic"].to_numpy(dtype=np.int64)
    if not len(rows) or not features or not (toxic > 0).any():
        return Model(features, np.zeros(len(features)), np.arange(grades - 1) + 20.0)
    density = np.array([sum(x) for x in rows["xs"]])
    levels = rows["grade"].to_numpy(dtype=np.int64) if grade else graded(toxic, density, grades)
    return Model(features, *fit_cumulative([list(i) for i in rows["ids"]], [list(x) for x in rows["xs"]], levels, len(features), grades))


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, toxic) for every row.

    ``expected_severity`` sums P(grade > k) over the thresholds, ``grade`` is the highest one more likely
    exceeded than not, ``toxic`` says grade 1 or more. Empty and NULL texts have no feature and count as
    clean; repeated rows are scored one by one; extra columns are ignored; an empty table gives no rows.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for k, text in enumerate(texts(batch)):
                found, words = counts(text, model.features, cache)
                if found:
                    ids, xs = values(found, words)
                    score[k] = model.weights[ids] @ np.array(xs)
            above = model.above(score)
            grade = (above > 0.5).sum(axis=1)
            yield {"doc_id": batch.column("doc_id"), "expected_severity": above.sum(axis=1), "grade": grade, "p_toxic": above[:, 0], "toxic": grade > 0}

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_rows(source, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean", body)
