"""Benchmark decontamination by the q-gram lemma.

An alignment of an item of length L with at most k edits keeps at least ``L - q + 1 - k q`` of its character
q-grams, and stays inside k + 1 neighbouring diagonals. So shared q-grams are counted in diagonal bands of
2 (k + 1), each overlapping the next by half; every alignment lies whole in one of them. Bands that reach the
bound are verified by banded alignment, the others can't hold a match.

The benchmark is a stated query set: it is read in blocks of bounded size, and each block's q-gram index is
broadcast and met by one pass over the documents. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from joulegrid.llm.common import arrow_rows, prepare, stored, texts

Q = 10
EDIT_SHARE = 0.08
BLOCK_CHARS = 2_000_000
_PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BITS = 20
_FOUND = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:int>>"


def normal(text: str) -> str:
    """Lower case and plain spaces, character by character, so that positions stay those of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for space in "\t\n\x0b\x0c\r":
        low = low.replace(space, " ")
    return low


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(values: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram, built by doubling."""
    if len(values) < q:
        return np.empty(0, dtype=np.uint64)
    whole, done, power, base = None, 0, values.astype(np.uint64), _BASE
    length, n = 1, len(values) - q + 1
    left = q
    while left:
        if left & 1:  # append this power of two to what is there
            part = power[done : done + n]
            whole = part.copy() if whole is None else whole * base + part
            done += length
        left >>= 1
        if left:
            power = power[:-length] * base + power[length:]
            base, length = base * base, length * 2
    return whole


@dataclass
class Index:
    """q-grams of some items, sorted, with the items and places they stand at."""

    q: int
    ids: list[int]
    items: list[np.ndarray]
    allowed: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    present: np.ndarray


def index(items: list[tuple[int, str]]) -> list[Index]:
    """One index for the usual q; items shorter than q have one of their own length and allow no edit."""
    by_q: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item_id, text in items:
        value = codes(normal(text or "").strip(" "))
        if len(value):
            by_q.setdefault(min(Q, len(value)), []).append((item_id, value))
    out = []
    for q, group in sorted(by_q.items()):
        lengths = np.array([len(v) for _, v in group], dtype=np.int64)
        allowed = np.minimum((lengths * EDIT_SHARE).astype(np.int64), (lengths - q) // q)
        with np.errstate(over="ignore"):
            hashes = [gram_hashes(v, q) for _, v in group]
        grams = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(group)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(grams, kind="stable")
        unique, first = np.unique(grams[order], return_index=True)
        present = np.zeros(1 << _BITS, dtype=bool)
        with np.errstate(over="ignore"):
            present[(unique * _MIX) >> np.uint64(64 - _BITS)] = True
        out.append(Index(q, [i for i, _ in group], [v for _, v in group], allowed, lengths - q + 1 - allowed * q, unique,
                         np.append(first, len(grams)), owner[order], place[order], present))
    return out


def hits(values: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, item, place in the item) of every shared q-gram, the text read in bounded pieces."""
    positions, slots = [], []
    for at in range(0, max(0, len(values) - ix.q + 1), _PIECE):
        with np.errstate(over="ignore"):
            hashes = gram_hashes(values[at : at + _PIECE + ix.q - 1], ix.q)
            maybe = np.flatnonzero(ix.present[(hashes * _MIX) >> np.uint64(64 - _BITS)])
        slot = np.searchsorted(ix.grams, hashes[maybe])
        sure = (slot < len(ix.grams)) & (ix.grams[np.minimum(slot, len(ix.grams) - 1)] == hashes[maybe])
        positions.append(maybe[sure] + at)
        slots.append(slot[sure])
    position, slot = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (positions, slots))
    width = ix.first[slot + 1] - ix.first[slot]
    spot = np.repeat(ix.first[slot] - np.cumsum(width) + width, width) + np.arange(width.sum())
    return np.repeat(position, width), ix.owner[spot], ix.place[spot]


def banded(item: np.ndarray, window: np.ndarray, width: int, limit: int, anchor: int | None = None) -> tuple[int, int]:
    """(edits, end in the window) of the best alignment of the item whose diagonals lie in 0..width-1; free end.

    The start is free in the window or, with ``anchor``, at its first character, which then stands on that
    diagonal. The least number of edits never falls from row to row, so an alignment beyond ``limit`` ends early.
    """
    steps, far = np.arange(width), len(item) + width + 1
    row = np.zeros(width, dtype=np.int64) if anchor is None else np.where(steps >= anchor, steps - anchor, far)
    shift = anchor or 0
    none = np.uint32(0xFFFFFFFF)
    padded = np.concatenate([np.full(shift, none), window, np.full(max(0, len(item) + width - shift - len(window)), none)])
    for i, c in enumerate(item):
        down = np.append(row[1:] + 1, far)
        row = np.minimum(row + (padded[i : i + width] != c), down)
        row = np.minimum.accumulate(row - steps) + steps
        if i % 8 == 7 and row.min() > limit:
            return limit + 1, 0
    best = int(np.argmin(row))
    return int(row[best]), min(best + len(item) - shift, len(window))


def matches(many: list[str], indexes: list[Index]) -> list[list[dict]]:
    """Per text every item found in it, at its best place of each matching band: item_id, start, end, edits.

    The texts are joined with a character that no text has, so that one vector pass serves all of them.
    """
    parts = [codes(normal(t)) for t in many]
    joint = np.full(1, 0xFFFFFFFE, dtype=np.uint32)
    values = np.concatenate([x for p in parts for x in (p, joint)]) if parts else joint
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    found: list[dict[tuple[int, int], dict]] = [{} for _ in many]
    for ix in indexes:
        position, item, place = hits(values, ix)
        if not len(position):
            continue
        doc = np.searchsorted(starts, position, side="right") - 1
        band = (position - starts[doc] - place) // (ix.allowed[item] + 1)
        pairs = np.unique(np.stack([np.tile(doc, 2), np.tile(item, 2), np.concatenate([band, band - 1])]), axis=1, return_counts=True)
        (docs, items, bands), count = pairs
        for d, i, j in zip(*(x[count >= ix.bound[items]].tolist() for x in (docs, items, bands))):
            spot = verified(ix.items[i], parts[d], j * (int(ix.allowed[i]) + 1), int(ix.allowed[i]))
            if spot:
                start, end, edits = spot
                name = (ix.ids[i], start)
                if name not in found[d] or found[d][name]["edits"] > edits:
                    found[d][name] = {"item_id": ix.ids[i], "start": start, "end": end, "edits": edits}
    return [[f[k] for k in sorted(f)] for f in found]


def grouped(many: list[str], chars: int = 1 << 17) -> Iterator[list[str]]:
    """The texts in order, in groups of about ``chars`` characters."""
    group, size = [], 0
    for text in many:
        group.append(text)
        size += len(text)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def verified(item: np.ndarray, values: np.ndarray, low: int, allowed: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of an alignment within the band's diagonals from ``low`` on, or None."""
    start = max(0, low)
    width = low + 2 * (allowed + 1) + (start - low) - start + 1
    window = values[start : start + len(item) + width]
    at = window.tobytes().find(item.tobytes())
    if at >= 0 and at % 4 == 0:
        return start + at // 4, start + at // 4 + len(item), 0
    edits, end = banded(item, window, width, allowed)
    if edits > allowed:
        return None
    # the same alignment from its end gives the start
    back = banded(item[::-1], window[:end][::-1], 2 * allowed + 1, allowed, anchor=allowed)
    return start + end - back[1], start + end, edits


def blocks(benchmark: DataFrame, bound: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks of about ``bound`` characters, read one after the other."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= bound:
            yield block
            block, size = [], 0
    if block:
        yield block


def scanned(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every document (``text`` among them) and ``_found``: its matches with all items."""
    spark = docs.sparkSession
    prepare(spark)
    out = docs.select(*columns, F.array().cast(_FOUND).alias("_found"))
    kind = out.schema
    for number, block in enumerate(blocks(benchmark)):
        known = spark.sparkContext.broadcast(index(block))

        def body(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[dict]:
            for batch in batches:
                before = batch.column("_found").to_pylist()
                now = [found for group in grouped(texts(batch)) for found in matches(group, known.value)]
                yield {c: batch.column(c) for c in columns} | {"_found": [a + b for a, b in zip(before, now)]}

        out = arrow_rows(stored(out) if number else out, kind, body)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, spans) for every row.

    A document is contaminated if it holds a benchmark text with at most eight per cent of its characters
    edited, case and kind of white space apart. NULL and empty texts hold none and empty items match
    nowhere; items shorter than q must occur exactly; repeated rows are judged one by one; extra columns
    are ignored; an empty table gives no rows, an empty benchmark no matches.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = scanned(source, benchmark, ["doc_id", "text"])
    ids = F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["item_id"])))
    return rows.select("doc_id", (F.size("_found") > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"), F.col("_found").alias("spans"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark text, with their columns; rows with NULL texts stay."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    return scanned(rows, benchmark, ["_row", "text"]).where(F.size("_found") == 0).select("_row.*")
