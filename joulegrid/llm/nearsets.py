"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

A prefix filter finds the candidates: of two similar sets each holds at least 0.8 of the other, so they share one of
their first n - ceil(0.8 n) + 1 shingles in any order that is common to all texts. Shingles of many texts come last in
that order, so buckets of one shingle stay small at every size of the corpus. Which shingles are frequent is a bit
array, counted over a hashed quarter of the texts: the order is free, so the sample changes no result. A second bit
array marks the prefix shingles that several texts have; only those become rows.

Every text first meets the texts that SimHash balls link it to and one other member of its largest bucket; what that links is contracted, then texts of buckets
with several groups meet two others, and at last all pairs that are still apart. A pair is compared only if sizes and
places of the shared shingle allow the similarity, at last also only if parities do: a text's shingles fall into
PARITIES classes, and texts that differ in k of these counts' parities differ in k shingles at least. No filter drops
a pair that could be similar.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from joulegrid.llm.common import arrow_rows, discard, few_ids, stored, texts
from joulegrid.llm.components import components
from joulegrid.llm.shingles import majority, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
# a shingle is frequent from so many sampled texts on; one text in SAMPLE is sampled, by its id
FREQUENT, SAMPLE = 4, 4
# classes of shingles whose counts' parities are kept for the texts compared last, in words of 64
PARITIES = 2048
# bits of an array that every task holds; beyond, more shingles share a bit, which only costs time
MOST_BITS = 30
_FLUSH = 2_000_000


def shingle_set(text: str) -> np.ndarray:
    """The distinct five-word shingles as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(text, SHINGLE))


def set_key(shingles: np.ndarray) -> int:
    """A number that names a set of shingles: 64 bits of its digest."""
    return int.from_bytes(xxhash.xxh3_128_digest(shingles.tobytes())[:8], "little", signed=True)


def parities(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in every class, as 64-bit words."""
    odd = np.bincount((shingles & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


@dataclass
class Bits:
    """A bit for every range of hashes: ``parts`` by their lowest bits, in each 2 ** ``width`` ranges of the 32 bits above."""

    parts: int
    width: int
    packed: np.ndarray

    @classmethod
    def shape(cls, values: int, share: int) -> tuple[int, int]:
        """Parts of about a million values each, and the width that gives a bit to one in ``share`` of the values."""
        bits = min(MOST_BITS, max(16, (values // share).bit_length()))
        part_bits = min(bits - 3, max(6, (values >> 20).bit_length()))
        return 1 << part_bits, bits - part_bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = _place(hashes, self.parts, self.width)
        return (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _place(hashes: np.ndarray, parts: int, width: int) -> np.ndarray:
    above = (hashes >> np.uint64(parts.bit_length() - 1)) & np.uint64(0xFFFFFFFF)
    return ((hashes & np.uint64(parts - 1)) << np.uint64(width)) | (above >> np.uint64(32 - width))


def _blobs(sets: Iterable[np.ndarray], parts: int) -> Iterator[dict]:
    """Hashes as blobs, one for each part, of four bytes a hash."""
    low = np.uint64(parts - 1)
    up = np.uint64(parts.bit_length() - 1)

    def flushed() -> dict:
        values = np.concatenate(held)
        part = (values & low).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, rest = part[order], (values[order] >> up).astype(np.uint32)
        names, starts = np.unique(part, return_index=True)
        return {"part": names, "blob": [v.tobytes() for v in np.split(rest, starts[1:])]}

    held: list[np.ndarray] = []
    size = 0
    for one in sets:
        held.append(one)
        size += len(one)
        if size > _FLUSH:
            yield flushed()
            held, size = [], 0
    if size:
        yield flushed()


def _marked(blobs: DataFrame, least: int, parts: int, width: int) -> Bits:
    """The bits of hashes that stand in at least ``least`` sets; a task counts one part at a time."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held = None, []

        def bits() -> dict:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            flags = np.zeros(1 << width, dtype=np.uint8)
            flags[values[counts >= least] >> np.uint32(32 - width)] = 1
            return {"part": [now], "bits": [np.packbits(flags, bitorder="little").tobytes()]}

        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                if part != now:
                    if held:
                        yield bits()
                    now, held = part, []
                held.append(np.frombuffer(blob, dtype=np.uint32))
        if held:
            yield bits()

    found = arrow_rows(blobs.repartition("part").sortWithinPartitions("part"), "part int, bits binary", counted).toArrow()
    packed = np.zeros((parts, 1 << (width - 3)), dtype=np.uint8)  # MOST_BITS bits at most
    for part, bits in zip(found.column("part").to_pylist(), found.column("bits").to_pylist()):
        packed[part] = np.frombuffer(bits, dtype=np.uint8)
    return Bits(parts, width, packed.reshape(-1))


def prefix(shingles: np.ndarray, frequent: Bits) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles in the order that all texts share: frequent ones last, then by hash."""
    late = frequent.has(shingles)
    return np.concatenate([shingles[~late], shingles[late]])[: prefix_size(len(shingles))]


def prefix_size(n: int) -> int:
    return n - math.ceil(SIMILARITY * n - 1e-9) + 1 if n else 0


def frequent_shingles(source: DataFrame, total: int) -> Bits:
    parts, width = Bits.shape(total // SAMPLE, 8)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        yield from _blobs((shingle_set(t) for batch in batches for t in texts(batch)), parts)

    sampled = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    return _marked(arrow_rows(sampled, "part int, blob binary", body), FREQUENT, parts, width)


def members(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """(shingle, node, n, rest, first, last, k): the prefix shingles of at least two nodes.

    ``rest`` counts the shingles of the node from this one on, ``first`` and ``last`` are the smallest and
    the largest of (node, n, rest) of the bucket, ``k`` its size.
    """
    spark = source.sparkSession
    sizes = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("n") / 5) + 1), F.lit(0))).first()
    frequent = spark.sparkContext.broadcast(frequent_shingles(source, int(sizes[0])))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_set(t) for t in texts(batch)]
            yield {"doc_id": batch.column("doc_id"), "node": [set_key(s) for s in sets], "n": [len(s) for s in sets], "prefix": [prefix(s, frequent.value).tobytes() for s in sets]}

    rows = arrow_rows(source, "doc_id long, node long, n int, prefix binary", prefixes)
    # of exact copies only the row with the smallest id goes on
    one = stored(nodes.select("doc_id", "node"))
    rows = stored(rows.join(few_ids(one), ["doc_id", "node"], "left_semi").select("node", "n", "prefix"))
    parts, width = Bits.shape(int(sizes[1]), 1)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        yield from _blobs((np.frombuffer(p, dtype=np.uint64) for batch in batches for p in batch.column("prefix").to_pylist()), parts)

    shared = spark.sparkContext.broadcast(_marked(arrow_rows(rows, "part int, blob binary", body), 2, parts, width))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {"shingle": [], "node": [], "n": [], "rest": []}
            for node, n, blob in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("prefix").to_pylist()):
                values = np.frombuffer(blob, dtype=np.uint64)
                at = np.flatnonzero(shared.value.has(values))
                held["shingle"].append(values[at].view(np.int64))
                held["node"].append(np.full(len(at), node, dtype=np.int64))
                held["n"].append(np.full(len(at), n, dtype=np.int32))
                held["rest"].append((n - at).astype(np.int32))
            yield {k: np.concatenate(v) for k, v in held.items()}

    found = stored(arrow_rows(rows, "shingle long, node long, n int, rest int", spread))
    whole = F.struct("node", "n", "rest")
    ends = found.groupBy("shingle").agg(F.min(whole).alias("first"), F.max(whole).alias("last"), F.count("*").alias("k"))
    out = stored(found.join(ends.where("first.node <> last.node"), "shingle"))
    discard(rows, one, found)
    for known in (frequent, shared):
        known.unpersist()
    return out


def _may(one: str, other: str) -> Column:
    """Whether two texts whose first common shingle this is can reach the similarity."""
    n, rest, m, other_rest = (F.col(c) for c in (f"{one}n", f"{one}rest", f"{other}n", f"{other}rest"))
    return F.least(rest, other_rest) >= SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-6


def _parities_may(other: str) -> Column:
    """The symmetric difference of similar sets is at most a ninth of their sizes; parities can't differ in more."""
    words = F.zip_with("odd", f"{other}odd", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(words, F.lit(0), lambda total, x: total + x) * 9 <= F.col("n") + F.col(f"{other}n")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similar_groups(docs: DataFrame, balls: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, node, root): texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    ``node`` names a distinct set of shingles, ``root`` its group. ``balls`` proposes pairs (a, b) of nodes from their
    SimHash fingerprints (node, fp); it gets the nodes that share a prefix shingle, since no others can be similar.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            hashes = [shingle_hashes(t, SHINGLE) for t in texts(batch)]
            sets = [np.unique(h) for h in hashes]
            prints = np.array([majority(h) if len(h) else 0 for h in hashes], dtype=np.uint64).view(np.int64)
            yield {"doc_id": batch.column("doc_id"), "node": [set_key(s) for s in sets], "n": [len(s) for s in sets], "fp": prints}

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = stored(arrow_rows(source, "doc_id long, node long, n int, fp long", body))
    nodes = stored(rows.where("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
    open_ones = members(source, nodes)
    # every text meets those within two bits of its fingerprint, as op10 links them, and the first member of its largest bucket
    prints = rows.where("doc_id IS NOT NULL").select("node", "fp").distinct().join(open_ones.select("node").distinct(), "node", "left_semi")
    near_prints = balls(prints)
    near = open_ones.where(_may("", "first.")).where("node <> first.node").groupBy("node").agg(F.max(F.struct("k", "first.node")).alias("to"))
    tried = stored(_pairs(near.select(F.col("node").alias("a"), F.col("to.node").alias("b")).unionByName(near_prints)))
    verified = stored(_verified(source, nodes, tried))
    linked = components(verified)
    # then the smallest and the largest group of its largest bucket, for as long as that links a good part of them
    asked, met = 1, 1
    while met and met * 4 >= asked:
        rest = _apart(open_ones, linked)
        sides = [
            rest.where(_may("", f"{end}.")).where(f"root <> {end}.root").groupBy(F.col("node").alias("a")).agg(F.max(F.struct("k", f"{end}.node")).alias("to")).select("a", F.col("to.node").alias("b"))
            for end in ("least", "most")
        ]
        fresh = stored(_pairs(sides[0].unionByName(sides[1])).join(tried, ["a", "b"], "left_anti"))
        asked, met, tried, verified, linked = _meet(source, nodes, fresh, tried, verified, linked)
        discard(open_ones)
        open_ones = rest
    rest = _apart(open_ones, linked).select("shingle", "node", "n", "rest", "root")
    odd = _of_nodes(source, nodes, rest.select("node"), "odd array<long>", lambda s: {"odd": [parities(x) for x in s]})
    rest = rest.join(odd, "node")
    other = rest.select("shingle", F.struct("node", "n", "rest", "root", "odd").alias("other"))
    both = rest.join(other, "shingle").where("node > other.node AND root <> other.root").where(_may("", "other.")).where(_parities_may("other."))
    fresh = stored(_pairs(both.select(F.col("node").alias("a"), F.col("other.node").alias("b"))).join(tried, ["a", "b"], "left_anti"))
    *_, linked = _meet(source, nodes, fresh, tried, verified, linked)
    return rows.select("doc_id", "node").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _apart(buckets: DataFrame, linked: DataFrame) -> DataFrame:
    """The buckets that hold several groups, with the members of the smallest and the largest group.

    Both come from a combining aggregate that is joined back, so no bucket is gathered.
    """
    placed = buckets.select("shingle", "node", "n", "rest").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed.select("shingle", "node", "n", "rest", "root"))
    one = F.struct("root", "node", "n", "rest")
    ends = placed.groupBy("shingle").agg(F.min(one).alias("least"), F.max(one).alias("most"), F.count("*").alias("k")).where("least.root <> most.root")
    out = stored(placed.join(ends, "shingle"))
    discard(placed)
    return out


def _meet(source: DataFrame, nodes: DataFrame, fresh: DataFrame, tried: DataFrame, verified: DataFrame, linked: DataFrame) -> tuple:
    """Verify the fresh pairs and contract what they link: (asked, met, tried, verified, linked)."""
    asked = fresh.count()
    if not asked:
        return 0, 0, tried, verified, linked
    more = stored(_verified(source, nodes, fresh))
    met = more.count()
    return asked, met, tried.unionByName(fresh), verified.unionByName(more), components(verified.unionByName(more)) if met else linked


def _of_nodes(source: DataFrame, nodes: DataFrame, wanted: DataFrame, kind: str, body: Callable[[list[np.ndarray]], dict]) -> DataFrame:
    """(node, ...): something of the shingle sets of the wanted nodes, read again from their texts and written once."""
    ids = stored(nodes.join(wanted.distinct(), "node", "left_semi").select("doc_id", "node"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_set(t) for t in texts(batch)]
            yield {"doc_id": batch.column("doc_id"), "node": [set_key(s) for s in sets]} | body(sets)

    chosen = source.join(few_ids(stored(ids.select("doc_id").distinct())), "doc_id", "left_semi")
    # of an id on several rows only those of its node; repeated rows repeat
    found = arrow_rows(chosen, f"doc_id long, node long, {kind}", made).join(few_ids(ids), ["doc_id", "node"], "left_semi")
    return stored(found.drop("doc_id"))


def _verified(source: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of nodes whose sets of five-word shingles reach the similarity; others are dropped."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = _of_nodes(source, nodes, wanted, "shingles binary", lambda s: {"shingles": [np.unique(x.astype(np.uint32)).tobytes() for x in s]})
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - shared
                kept.append(union == 0 or shared >= SIMILARITY * union)
            yield {"a": batch.column("a"), "b": batch.column("b"), "kept": kept}

    # repeated rows of one text give a pair several times
    return arrow_rows(both.select("a", "b", "x", "y"), "a long, b long, kept boolean", measured).where("kept").select("a", "b").distinct()
