"""Substring duplicates by content-defined chunking with a gear rolling hash.

A cut follows every place where the rolling hash of the last characters has its low mask bits clear, within
a least and a largest chunk length, so an insertion moves the cuts only near it. Chunks are compared by
128-bit digest; runs of repeated chunks that are long enough are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from joulegrid.llm.common import arrow_rows, stored, texts

LEAST, LARGEST = 16, 128
MASK_BITS = 5
WINDOW = 16
MIN_SPAN = 100
_GEAR = np.random.default_rng(2024).integers(0, 1 << 32, size=256, dtype=np.uint32)
_PIECE = 1 << 20
_KINDS = {"row": pa.int64(), "doc_id": pa.int64(), "n_chars": pa.int64(), "start": pa.int32(), "end": pa.int32(), "d1": pa.int64(), "d2": pa.int64(), "again": pa.bool_()}


def cuts(text: str) -> list[int]:
    """Chunk ends in characters; the last is the length of the text."""
    values = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(values)
    marks = []
    for at in range(0, n, _PIECE):  # with the characters before the piece that its first hashes need
        low = max(0, at - WINDOW + 1)
        part = values[low : at + _PIECE]
        h = _GEAR[(part ^ (part >> 8)) & 255]
        step = 1
        while step < WINDOW:  # h[i] sums gear[i - j] << j over the window, by doubling
            h = h.copy()
            h[step:] += (h[:-step] << np.uint32(step))
            step *= 2
        # the highest of the window's bits depend on all of it
        hit = np.flatnonzero((h[at - low :] >> np.uint32(WINDOW - MASK_BITS)) & np.uint32((1 << MASK_BITS) - 1) == 0)
        marks.append(hit + at + 1)
    ends, last = [], 0
    for mark in (np.concatenate(marks).tolist() if marks else []):
        while mark - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if mark - last >= LEAST:
            last = mark
            ends.append(last)
    while n - last > LARGEST:
        last += LARGEST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_chars, start, end, d1, d2, again): every chunk of every whole text.

    ``row`` names the row of ``docs``, ``again`` says the chunk stood earlier in the same text. A text
    without characters gives one line of no chunk (NULL digests).
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                row, at = part << 40 | at, at + 1
                ends = cuts(text)
                starts = [0, *ends[:-1]] if ends else []
                digests = [xxhash.xxh3_128_digest(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(starts, ends)]
                seen: set[bytes] = set()
                again = [d in seen or seen.add(d) is not None for d in digests]
                pair = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
                n = max(1, len(ends))
                none = not ends
                yield {
                    "row": np.full(n, row), "doc_id": pa.array([doc_id] * n, pa.int64()), "n_chars": np.full(n, len(text)),
                    "start": [None] if none else starts, "end": [None] if none else ends,
                    "d1": [None] if none else pair[:, 0], "d2": [None] if none else pair[:, 1], "again": [False] if none else again,
                }

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """The lines of several texts as one batch."""
        held: list[dict] = []
        for one in body(batches):
            held.append(one)
            if sum(len(h["again"]) for h in held[-1:]) > 50_000 or len(held) >= 500:
                yield _together(held)
                held = []
        if held:
            yield _together(held)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = "row long, doc_id long, n_chars long, start int, end int, d1 long, d2 long, again boolean"
    return arrow_rows(source, kind, merged)


def _together(held: list[dict]) -> dict:
    return {name: pa.concat_arrays([pa.array(h[name], kind) for h in held]) for name, kind in _KINDS.items()}


def repeated_spans(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(row, doc_id, n_chars, n_chunks, spans, later): repeated passages of every row.

    ``spans`` are runs of neighbouring chunks that stand in at least two texts, of ``min_span`` characters
    or more; ``later`` those parts that stand in an earlier row too, which deduplication removes.
    The digests are counted with a combining aggregate, and the join back splits a digest with very many
    chunks, so a passage that many documents share is no hot task.
    """
    lines = stored(chunks(docs))
    real = lines.where("d1 IS NOT NULL")
    shared = real.where("NOT again").groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1")
    hits = real.select("row", "start", "end", "d1", "d2", "again").join(shared.drop("n"), ["d1", "d2"])
    later = (F.col("row") > F.col("first")) | F.col("again")
    lists = hits.groupBy("row").agg(F.collect_list(F.struct("start", "end", later.alias("later"))).alias("hits"))
    rows = lines.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.count("d1").alias("n_chunks"))
    joined = rows.join(lists, "row", "left")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            spans, gone = [], []
            for found in batch.column("hits").to_pylist():
                runs = _runs(sorted((h["start"], h["end"], h["later"]) for h in found or []))
                runs = [r for r in runs if r[-1][1] - r[0][0] >= min_span]
                spans.append([{"start": r[0][0], "end": r[-1][1]} for r in runs])
                parts = [p for r in runs for p in _runs([h for h in r if h[2]]) if p[-1][1] - p[0][0] >= min_span]
                gone.append([{"start": p[0][0], "end": p[-1][1]} for p in parts])
            yield {c: batch.column(c) for c in ("row", "doc_id", "n_chars", "n_chunks")} | {"spans": spans, "later": gone}

    span = "array<struct<start:int,end:int>>"
    return arrow_rows(joined, f"row long, doc_id long, n_chars long, n_chunks long, spans {span}, later {span}", body)


def _runs(found: list[tuple[int, int, bool]]) -> list[list[tuple[int, int, bool]]]:
    runs: list[list[tuple[int, int, bool]]] = []
    for hit in found:
        if runs and runs[-1][-1][1] == hit[0]:
            runs[-1].append(hit)
        else:
            runs.append([hit])
    return runs


def repeats(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(doc_id, n_chars, n_chunks, repeated, n_repeated_chars, n_removed_chars, spans) for every row.

    ``repeated`` says the text holds a passage that another text holds too; ``n_removed_chars`` is what
    deduplication takes from it, the first text keeping its copy. NULL and empty texts have no chunk;
    repeated rows are repeats of each other; extra columns are ignored; an empty table gives no rows.
    """
    found = repeated_spans(docs, min_span)
    length = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    listed = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", "n_chars", "n_chunks", (F.size("spans") > 0).alias("repeated"), length("spans").alias("n_repeated_chars"), length("later").alias("n_removed_chars"), listed.alias("spans"))
