"""Quality rules with thresholds that adapt to each language and source.

Every metric is counted into logarithmic buckets of one per cent relative width per language and source.
Such histograms are mergeable quantile sketches: buckets add up over tasks and up the hierarchy, their
number is bounded by the range of the metric, and the result does not depend on the order of rows.
The fences of a cell are shrunk towards those of its language, and these towards the corpus, by the cell's documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from joulegrid.llm.common import arrow_rows, stored, texts

SYMBOLS = "#*$%&|<>"
_SPACES = "\t\n\x0b\x0c\r "
# metric: (side of the fence, slack added to the fence)
METRICS = {
    "symbol_ratio": (1, 0.02),
    "repeat_ratio": (1, 0.10),
    "dup_line_ratio": (1, 0.20),
    "mean_word": (1, 1.0),
    "mean_word_low": (-1, 1.0),
}
WIDTH = 0.01
LEAST = 1e-4
# documents that the level above counts for
PRIOR = 200.0
MIDDLE, OUTER, REACH = 0.5, 0.9, 3.0
FEWEST_WORDS = 50


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a window of three words that occurs at least twice, the first occurrence included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    order = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    pairs = np.unique(order[:-1] * len(ids) + order[1:], return_inverse=True)[1]
    _, windows, counts = np.unique(pairs[:-1] * len(ids) + order[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII spaces
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    filled = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(words), chars, symbols, len(filled) - len(set(filled)), repeated_words(words), len(filled)


def measured(docs: DataFrame) -> DataFrame:
    """One row per document with its counts; a NULL text counts as empty."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            counts = [text_counts(t) for t in texts(batch)]
            kept = {name: batch.column(name) for name in ("doc_id", "lang", "source")}
            yield kept | {name: [c[i] for c in counts] for i, name in enumerate(names)}

    source = docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("lang", "source", "text")])
    return arrow_rows(source, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names), body)


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.lit(1), F.col(b))


def _metrics() -> dict[str, Column]:
    mean = _ratio("word_chars", "n_words")
    return {
        "symbol_ratio": _ratio("n_symbols", "word_chars"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        # one repeated line among a few says little, so short texts are damped
        "dup_line_ratio": F.col("n_dup_lines") / (F.col("n_lines") + 4),
        "mean_word": mean,
        "mean_word_low": mean,
    }


def _bucket(value: Column) -> Column:
    return F.when(value <= LEAST, F.lit(0)).otherwise(F.ceil(F.log(value / LEAST) / float(np.log1p(WIDTH))).cast("int"))


def sketches(rows: DataFrame) -> DataFrame:
    """(level, lang, source, metric, bucket, n): counts per cell, per language and for the corpus."""
    pairs = [F.struct(F.lit(name).alias("metric"), _bucket(value).alias("bucket")) for name, value in _metrics().items()]
    cells = rows.select("lang", "source", F.explode(F.array(*pairs)).alias("m")).groupBy("lang", "source", "m").agg(F.count("*").alias("n"))
    cells = cells.select(F.lit(2).alias("level"), "lang", "source", "m.metric", "m.bucket", "n")
    langs = cells.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = langs.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return (
        cells.unionByName(langs.select(F.lit(1).alias("level"), "lang", none.alias("source"), "metric", "bucket", "n"))
        .unionByName(whole.select(F.lit(0).alias("level"), none.alias("lang"), none.alias("source"), "metric", "bucket", "n"))
    )


def fences(counts: DataFrame) -> DataFrame:
    """(level, lang, source, n, fence_<metric>...): the outer quantile, three times its distance from the median beyond."""
    cell = Window.partitionBy("level", "lang", "source", "metric")
    upto = counts.withColumn("_upto", F.sum("n").over(cell.orderBy("bucket"))).withColumn("_all", F.sum("n").over(cell))

    def quantile(q: float) -> Column:
        at = F.min(F.when(F.col("_upto") >= F.col("_all") * q, F.col("bucket")))
        return F.when(at == 0, F.lit(0.0)).otherwise(F.lit(LEAST) * F.pow(F.lit(1 + WIDTH), at))

    quantiles = upto.groupBy("level", "lang", "source", "metric").agg(
        F.max("_all").alias("n"), quantile(MIDDLE).alias("mid"), quantile(OUTER).alias("high"), quantile(1 - OUTER).alias("low")
    )
    high = F.col("high") + REACH * (F.col("high") - F.col("mid"))
    low = F.col("low") - REACH * (F.col("mid") - F.col("low"))
    return quantiles.groupBy("level", "lang", "source").agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("metric") == m, (high if side > 0 else low) + side * slack)).alias(f"fence_{m}") for m, (side, slack) in METRICS.items()],
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, fence_<metric>...) for every cell: n of its own documents against PRIOR of the level above."""
    found = stored(fences(sketches(rows)))
    names = [f"fence_{m}" for m in METRICS]
    whole = found.where(F.col("level") == 0).first()  # one row

    def shrunk(own: str, name: str, above: Column) -> Column:
        return (F.col(f"{own}n") * F.col(f"{own}{name}") + PRIOR * above) / (F.col(f"{own}n") + PRIOR)

    corpus = {name: F.lit(float(whole[name]) if whole else None).cast("double") for name in names}
    langs = found.where(F.col("level") == 1).select(F.col("lang").alias("_lang"), *[shrunk("", name, corpus[name]).alias(f"_{name}") for name in names])
    cells = found.where(F.col("level") == 2).join(langs, F.col("lang").eqNullSafe(F.col("_lang")))
    return cells.select("lang", "source", *[shrunk("", name, F.col(f"_{name}")).alias(name) for name in names])


def judged(docs: DataFrame) -> DataFrame:
    """The counts of every document, ``base_failed`` and ``kept``.

    A NULL text has no words and fails the base rules; NULL languages and sources are cells of their own;
    repeated rows are counted and judged one by one; extra columns are ignored; an empty table gives no rows.
    """
    rows = stored(measured(docs))
    cells = stored(thresholds(rows))
    limits = cells.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    values = _metrics()
    inside = F.lit(True)
    for metric, (side, _) in METRICS.items():
        fence = F.col(f"fence_{metric}")
        inside &= values[metric] <= fence if side > 0 else values[metric] >= fence
    return rows.join(limits, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & inside).alias("kept"),
    )
