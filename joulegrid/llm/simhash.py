"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most two bits exactly when one fingerprint is within one bit of both.
So every distinct fingerprint emits itself and its 64 one-bit variants; one shuffle on the variant brings
together at most 65 distinct fingerprints, all of them within two bits of each other, and each is linked to
the smallest of its bucket. That keeps every connection without writing all pairs of a bucket.
Copies share a fingerprint and are collapsed before variants are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from joulegrid.llm.common import arrow_rows, few_ids, stored, texts
from joulegrid.llm.components import components
from joulegrid.llm.nearsets import SHINGLE, set_key, shingle_set, similar_groups
from joulegrid.llm.shingles import majority, shingle_hashes


def fingerprint(text: str, size: int) -> int:
    """SimHash over word shingles; a text without words has fingerprint zero."""
    hashes = shingle_hashes(text, size)
    return majority(hashes) if len(hashes) else 0


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row. NULL and blank texts have fingerprint zero."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "fp": _signed([fingerprint(t, size) for t in texts(batch)])}

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, fp long", body)


def _variants(fp: Column, bits: int) -> Column:
    flips = [F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(bits)]]
    return F.transform(F.array(*flips), lambda flip: flip.bitwiseXOR(fp))


def links(prints: DataFrame, keys: tuple[str, ...] = (), bits: int = 64) -> DataFrame:
    """Links (keys, a, b) that connect distinct fingerprints ``fp`` at two or fewer differing bits.

    ``keys`` separates independent families of fingerprints. A bucket holds at most ``bits`` + 1 rows.
    """
    emitted = prints.select(*keys, "fp", F.explode(_variants(F.col("fp"), bits)).alias("_variant"))
    least = F.min("fp").over(Window.partitionBy(*keys, "_variant"))
    found = emitted.select(*keys, F.col("fp").alias("a"), least.alias("b")).where("a <> b")
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def ball_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): nodes of (node, fp) whose fingerprints are equal or linked, by one member of every fingerprint."""
    prints = stored(prints)
    least = stored(prints.groupBy("fp").agg(F.min("node").alias("node")))
    equal = prints.select("fp", F.col("node").alias("a")).join(least.select("fp", F.col("node").alias("b")), "fp").select("a", "b")
    ends = [least.select(F.col("fp").alias(f"_{end}"), F.col("node").alias(end)) for end in ("a", "b")]
    found = links(least.select("fp")).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return equal.unionByName(found.join(ends[0], "_a").join(ends[1], "_b").select("a", "b")).where("a <> b")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row, linked at two or fewer differing bits.

    ``component_id`` is the smallest doc_id reachable. Repeated rows and ties share a component, rows with
    a NULL doc_id get the component of their fingerprint (NULL where no linked row has an id), extra
    columns are ignored, an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, size))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    linked = components(links(distinct.select("fp")))
    placed = distinct.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left")
    placed = stored(placed.select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    heads = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = placed.join(heads, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with one row per group of near-duplicates: the one with the smallest doc_id.

    Keeps the columns of ``docs``. Repeated rows collapse to one; different texts under one doc_id are judged
    apart (of those in one group the first in order stays). Blank texts are one group, rows with a NULL doc_id
    are kept (they can't be told apart). An empty table stays empty. Only ids that go, or that stand on
    several rows, are joined to the texts.
    """
    groups = stored(similar_groups(docs, ball_pairs).where("doc_id IS NOT NULL"))
    heads = groups.groupBy("root").agg(F.min("doc_id").alias("head"))
    judged = stored(groups.join(heads, "root").select("doc_id", "node", "root", (F.col("doc_id") == F.col("head")).alias("kept")))
    ids = stored(judged.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    plain = docs.join(few_ids(stored(ids.where("NOT kept OR n > 1").select("doc_id"))), "doc_id", "left_anti").select(*docs.columns)
    several = stored(ids.where("kept AND n > 1").select("doc_id"))
    if several.isEmpty():
        return plain

    @F.pandas_udf("long")
    def key(text: pd.Series) -> pd.Series:
        return pd.Series([set_key(shingle_set(t or "")) for t in text], dtype="int64")

    shared = docs.join(few_ids(several), "doc_id", "left_semi").select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    verdicts = judged.join(several, "doc_id", "left_semi").where("kept").select("doc_id", "node", "root").distinct()
    shared = shared.withColumn("node", key("text")).join(verdicts, ["doc_id", "node"])
    order = Window.partitionBy("doc_id", "root").orderBy(F.col("text").asc_nulls_first())
    nth = shared.withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    return plain.unionByName(nth.select("_row.*"))
