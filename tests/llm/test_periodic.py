"""Periodic runs against a search of all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from joulegrid.llm import common, periodic, queries

SF = "/root/testdata/sf0.001"


def brute(words) -> list[tuple[int, int, int]]:
    """Every maximal stretch for every period; kept under its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            a = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = a - q, i - a + q
            if length >= max(24, 3 * q) and not any(s <= start and start + length <= s + m and q % p == 0 for s, m, p in found):
                found[start, length, q] = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def searched(words: list[bytes]) -> list[tuple[int, int, int]]:
    return periodic.text_runs(words, periodic.stretches([words])[0])


def periodic_words(r: random.Random) -> list[bytes]:
    words: list[int] = []
    for _ in range(r.randrange(1, 6)):
        root = [r.randrange(r.choice([1, 2, 3, 40])) for _ in range(r.randrange(1, 14))]
        if r.random() < 0.4:
            root = (root * 9)[: r.randrange(20, 60)]  # a period that holds repeats itself
        size = r.randrange(2, 120)
        words += (root * size)[:size]
        words += [r.randrange(50) for _ in range(r.randrange(0, 5))]
    return [str(w).encode() for w in words]


def test_automaton_against_all_periods():
    r = random.Random(1)
    for _ in range(600):
        words = periodic_words(r)
        want = brute(words)
        ids: dict[bytes, int] = {}
        assert periodic.runs_of([ids.setdefault(w, len(ids)) for w in words]) == want
        assert searched(words) == want


def test_batches_keep_texts_apart():
    r = random.Random(2)
    batch = [periodic_words(r) for _ in range(30)] + [[], [b"a"] * 23, [b"a"] * 24, [b"a"] * 15]
    batch += [batch[0], [b"a"] * 24]
    parts = periodic.stretches(batch)
    assert [periodic.text_runs(w, p) for w, p in zip(batch, parts)] == [brute(w) for w in batch]


def test_hostile_long_texts_end():
    one = [b"a"] * 150_000
    assert searched(one) == [(0, 150_000, 1)]
    two = [b"a", b"b"]
    while len(two) < 60_000:  # a Fibonacci word is full of squares
        two = (two + two[: len(two) * 618 // 1000])[:60_000]
    assert all(n >= max(24, 3 * q) for _, n, q in searched(two))
    r = random.Random(4)
    root = [str(r.randrange(9)).encode() for _ in range(30_000)]
    assert searched(root * 3 + root[:7]) == [(0, 90_007, 30_000)]


def test_rows_on_edges(spark):
    line = " ".join(["x y"] * 20)
    rows = [(1, line, 5), (1, line, 5), (None, line, 5), (2, None, 5), (3, "", 5), (4, " \n\t", 5), (5, "é b " * 24, 5), (6, "a\x1cb\x85 " * 30, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("n_words", F.lit("x")).withColumn("collapsed", F.lit(1))
    out = periodic.periodic_runs(docs)
    got = sorted(out.collect(), key=str)
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and periodic.periodic_runs(docs.limit(0)).count() == 0
    assert [tuple(x) for x in by[1]["runs"]] == [(0, 40, 2)] and by[1]["collapsed"] == "x y" and by[None]["collapsed"] == "x y"
    assert all(by[i]["runs"] == [] and by[i]["n_words"] == 0 and by[i]["collapsed"] == "" for i in (2, 3, 4))
    assert [tuple(x) for x in by[5]["runs"]] == [(0, 24, 1)] and by[5]["collapsed"] == "é b" and by[6]["collapsed"] == "a\x1cb\x85"


def test_query_against_all_periods(spark):
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").collect()}
    planted = 0
    for row in queries.op13_runs(spark, SF).collect():
        words = (texts[row["doc_id"]] or "").encode().split()
        n, h = len(words), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and n:
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words) if n < 1500 else searched(words)
        planted += h % 10 == 0 and bool(runs)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert row["n_runs"] == len(runs) and row["n_words"] == n
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert planted >= 3
