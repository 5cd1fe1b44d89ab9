"""Quality classifier: document evidence shrunk by host and path posteriors (hierarchical empirical Bayes).

A logistic model of a few style features gives every document its evidence. Each site (host) and each path
of a site then gets a posterior rate of good documents: the mean evidence of all its documents, shrunk
towards the level above by a beta prior whose strength the spread of the rates themselves decides. Sparse
sites lean on the whole corpus, large ones on their own documents. A document's posterior joins its evidence
with the rate of its path as prior odds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from joulegrid.llm.common import arrow_rows, labelled, stored, texts

SAMPLE_ROWS = 20_000  # bound of the labelled rows a fit reads
RIDGE = 1.0
THRESHOLD = 0.5
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_SPACES = "\t\n\x0b\x0c\r "
FEATURES = ["words", "symbols", "pipes", "bangs", "upper", "adjacent", "distinct", "dup_lines", "mean_word", "digits"]


def features(text: str) -> list[float]:
    """Style of one text in ``FEATURES`` order; an empty text gives zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text) - sum(map(text.count, _SPACES))
    lines = [line for line in text.split("\n") if line.strip()]
    count = lambda marks: sum(map(text.count, marks))
    return [
        np.log1p(n),
        min(1.0, count("#*$%&") / n),
        min(1.0, count("|<>") / n),
        min(1.0, text.count("!!") / n),
        sum(map(len, _UPPER.findall(text))) / max(1, chars),
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(words)) / n**0.8,
        (len(lines) - len(set(lines))) / (len(lines) + 4),
        chars / n / 10,
        count("0123456789") / max(1, chars),
    ]


@dataclass
class Model:
    """Weights on standardised features; ``rate`` is the share of good rows in the sample."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rate: float

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of good over bad: the fitted log-odds without the sample's own odds."""
        x = np.clip((rows - self.mean) / self.scale, -20, 20)
        return np.clip(x @ self.weights[1:] + self.weights[0] - np.log(self.rate / (1 - self.rate)), -30, 30)


def fitted(x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton steps. One class alone gives a model without evidence."""
    width = len(FEATURES)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), 0.5)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -20, 20)])
    w, penalty = np.zeros(width + 1), np.diag([0.0] + [RIDGE] * width)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty @ w
        curved = z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty + 1e-9 * np.eye(width + 1)
        move = np.linalg.solve(curved, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return Model(mean, scale, w, float(y.mean()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``bound`` labelled documents; only their ten numbers each reach the driver."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"y": batch.column("y"), "x": [features(t) for t in texts(batch)]}

    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    rows = labelled(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), known, bound)
    found = arrow_rows(rows.select("y", "text"), "y double, x array<double>", body).toPandas()
    return fitted(np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(FEATURES)), found["y"].to_numpy(dtype=float))


def with_evidence(rows: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of the rows and ``_llr``, the evidence of the text; an empty text has none (zero)."""
    spark_type = rows.select(*columns, F.lit(0.0).alias("_llr")).schema

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            many = texts(batch)
            llr = model.evidence(np.array([features(t) for t in many])) if many else np.empty(0)
            llr = np.where([bool(t.strip()) for t in many], llr, 0.0)
            yield {c: batch.column(c) for c in columns} | {"_llr": llr}

    return arrow_rows(rows, spark_type, body)


def _strength(groups: DataFrame, mean: Column | float) -> float:
    """Strength of the beta prior by moments: the spread of the group rates beyond sampling noise."""
    m = F.lit(mean) if isinstance(mean, float) else mean
    rate = F.col("good") / F.col("n")
    spread = F.sum(F.col("n") * F.pow(rate - m, 2)) / F.sum("n")
    row = groups.agg(spread.alias("v"), F.sum(F.col("n") * m * (1 - m)).alias("w"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not row["n"]:
        return 1.0
    within = row["w"] / row["n"]
    noise = within * row["k"] / row["n"]
    return float(np.clip(within / max(row["v"] - noise, 1e-9) - 1, 1.0, 1e6))


def _soft(llr: Column) -> Column:
    """The chance of a good document by its evidence alone, in whole millionths: sums don't depend on the order of rows."""
    return F.round(1e6 / (1 + F.exp(-llr))).cast("long")


def sites(evidence: DataFrame) -> DataFrame:
    """(host, path, rate, good, n, host_good, host_n, k_path, k_host, mean) from (host, path, _llr) of all documents.

    ``rate`` is the posterior rate of good documents on the path, ``good`` sums the documents' chances in
    millionths, the ``k`` are the strengths of the priors. Sums are combined
    in each task first, so a host with a third of all documents is no hot key. Two levels of one row per site
    remain. NULL hosts and paths are sites of their own.
    """
    paths = stored(evidence.groupBy("host", "path").agg(F.sum(_soft(F.col("_llr"))).alias("good"), F.count("*").alias("n")))
    hosts = stored(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))
    whole = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    mean = whole["good"] / 1e6 / whole["n"] if whole["n"] else 0.5
    share = (F.col("good") / 1e6).alias("good")
    k_host = _strength(hosts.select(share, "n"), mean)
    named = hosts.select(F.col("host").alias("_host"), F.col("good").alias("host_good"), F.col("n").alias("host_n"))
    joined = paths.join(named, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    rate = (F.col("host_good") / 1e6 + k_host * mean) / (F.col("host_n") + k_host)
    k_path = _strength(joined.select(share, "n", rate.alias("host_rate")), F.col("host_rate"))
    shrunk = (F.col("good") / 1e6 + k_path * rate) / (F.col("n") + k_path)
    return stored(joined.withColumns({"rate": shrunk, "k_path": F.lit(k_path), "k_host": F.lit(k_host), "mean": F.lit(mean)}))


def posterior(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` (host, path, _llr, ...) with ``host_rate``, ``path_rate`` and ``p_good``.

    The rates are those of the site's other documents, shrunk path to host to corpus: a document's evidence counts
    once, and one that is alone on its site gets the rate of what stands above.
    """
    named = places.withColumnsRenamed({"host": "_host", "path": "_path"})
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    own = _soft(F.col("_llr"))
    host_rate = ((F.col("host_good") - own) / 1e6 + F.col("k_host") * F.col("mean")) / (F.col("host_n") - 1 + F.col("k_host"))
    path_rate = ((F.col("good") - own) / 1e6 + F.col("k_path") * F.col("host_rate")) / (F.col("n") - 1 + F.col("k_path"))
    out = rows.join(named, same).withColumn("host_rate", host_rate)
    out = out.withColumn("path_rate", F.least(F.lit(0.999), F.greatest(F.lit(0.001), path_rate)))
    odds = F.col("_llr") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    return out.drop(*[c for c in named.columns]).withColumn("p_good", 1 / (1 + F.exp(-odds)))


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", bound: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, p_good, kept) for every row.

    Empty and NULL texts carry no evidence and get the rate of their path; NULL hosts and paths are sites of
    their own; repeated rows are scored one by one; labels without a document are ignored; without labels of
    both classes there is no evidence and everything is kept. An empty table gives no rows.
    """
    model = fit(docs, labels, bound=bound)
    source = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col("text").cast("string"))
    rows = stored(with_evidence(source, model, ["doc_id", "host", "path"]))
    out = posterior(rows, sites(rows))
    return out.select("doc_id", "host", "path", F.col("_llr").alias("evidence"), "host_rate", "path_rate", "p_good", (F.col("p_good") >= THRESHOLD).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", bound: int = SAMPLE_ROWS) -> DataFrame:
    """The documents the classifier keeps, with their columns. Only site rates are joined, never texts by id.

    Every row is judged alone: NULL and empty texts by the rate of their site, rows with a NULL doc_id and repeated
    rows like all others; an empty table stays empty.
    """
    model = fit(docs, labels, bound=bound)
    keys = [F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path")]
    places = sites(with_evidence(docs.select(*keys, F.col("text").cast("string")), model, ["host", "path"]))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), *keys, F.col("text").cast("string").alias("text"))
    rows = with_evidence(whole, model, ["_row", "host", "path"])
    return posterior(rows, places).where(F.col("p_good") >= THRESHOLD).select("_row.*")
