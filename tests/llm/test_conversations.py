"""Structure repair against a table of whole audits, in one piece and in many."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from joulegrid.llm import common, conversations as conv, oracles, queries

SF = "/root/testdata/sf0.001"
TEXTS = ["Yes.", "No!", "why", "", " \n", "a?", "b. c", "Fine. \n"]


def legal(initials: str) -> bool:
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def brute(rows) -> tuple[int, str, list[str]]:
    """(cost, audit, lines): for every prefix and state the least (cost, audit) over all edits, whole audits compared."""
    seen, best = set(), {"": (0, "", [])}  # by the initials modulo repeats of ua: '', s, u, ua

    def state(initials):
        return initials[-1:] if initials[-1:] != "a" else "a"

    def offer(into, key, one):
        if key not in into or one[:2] < into[key][:2]:
            into[key] = one

    def follow(s, i):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((s, i))

    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for s, (c, audit, lines) in list(out.items()):
                for i, role in (("u", "user"), ("a", "assistant")):
                    if follow(s, i):
                        offer(out, follow(s, i), (c + 2, audit + "I", lines + [f"{role}:"]))
        return out

    for _, role, text in rows:
        must = not text.strip(" \t\n\x0b\x0c\r") or (role, text) in seen
        seen.add((role, text))
        cut = not re.search(r"[.!?][ \t\n\x0b\x0c\r]*\Z", text)
        after = {}
        # insertions before a row don't compete with staying: every number of them is tried
        ways = [(s, *v) for s, v in best.items()]
        for _ in range(3):
            ways += [(follow(s, i), c + 2, a + "I", ls + [f"{r}:"]) for s, c, a, ls in ways for i, r in (("u", "user"), ("a", "assistant")) if follow(s, i)]
        for s, c, a, ls in ways:
            offer(after, s, (c + 3, a + "D", ls))
            if not must:
                if follow(s, role[:1]):
                    offer(after, follow(s, role[:1]), (c + cut, a + "K", ls + [f"{role}:{text}"]))
                for i, r in (("u", "user"), ("a", "assistant")):
                    if follow(s, i):
                        offer(after, follow(s, i), (c + 2 + cut, a + "R", ls + [f"{r}:{text}"]))
        best = after
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def talk(r: random.Random, n: int) -> list[tuple]:
    rows, turn = [], 0
    for k in range(n):
        turn += r.choice([1, 1, 1, 2, 0])
        role = r.choice(["user", "assistant", "system", "tool", "", "unit"]) if r.random() < 0.3 else ("user", "assistant")[k % 2]
        rows.append((r.choice([turn, turn, turn, None]), role, r.choice(TEXTS) + (str(r.randrange(40)) + "." if r.random() < 0.6 else "")))
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def test_edits_against_all_edit_sequences():
    """Tiny conversations: every sequence of edits of a bounded length is tried."""
    r = random.Random(1)
    for _ in range(60):
        rows = talk(r, r.randrange(1, 4))
        seen, kinds = set(), []
        for _, role, text in rows:
            kinds.append((role, text, conv.is_blank(text) or (role, text) in seen, conv.is_truncated(text)))
            seen.add((role, text))
        found = []
        for size in range(len(rows), len(rows) + 4):
            for edits in itertools.product("DIKR", repeat=size):
                if size - edits.count("I") != len(rows):
                    continue
                given, options = iter(kinds), [("", 0)]
                for e in edits:
                    if e == "I":
                        options = [(s + i, c + 2) for s, c in options for i in "ua"]
                        continue
                    role, _, must, cut = next(given)
                    if e == "D":
                        options = [(s, c + 3) for s, c in options]
                    elif must:
                        options = []
                    elif e == "K":
                        options = [(s + (role[:1] or "?"), c + cut) for s, c in options]
                    else:
                        options = [(s + i, c + 2 + cut) for s, c in options for i in "ua"]
                found += [(c, "".join(edits)) for s, c in options if legal(s)]
        got = conv.repair(rows)
        assert (got["cost"], got["audit"]) == min(found)


def test_divide_and_conquer_against_whole_audits():
    r = random.Random(2)
    for _ in range(400):
        rows = talk(r, r.randrange(0, 40))
        cost, audit, lines = brute(rows)
        got = conv.repair(rows)
        assert (got["cost"], got["audit"], got["repaired"]) == (cost, audit, "\n".join(lines))
        initials = "".join(line.partition(":")[0][:1] for line in lines)
        assert legal(initials) and got["lines"] == len(lines)


def expected(rows, copies) -> list[tuple]:
    by: dict = {}
    for (c, turn, role, text), n in zip(rows, copies):
        by.setdefault(c, []).extend([(turn, role if role is not None else " ", text if text is not None else " ")] * n)
    out = []
    for c, given in by.items():
        given.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        cost, audit, lines = brute(given)
        turns = {t for t, _, _ in given if t is not None}
        blank = dup = cut = 0
        seen = set()
        for _, role, text in given:
            if not text.strip(" \t\n\x0b\x0c\r"):
                blank += 1
            elif (role, text) in seen:
                dup += 1
            elif not re.search(r"[.!?][ \t\n\x0b\x0c\r]*\Z", text):
                cut += 1
            seen.add((role, text))
        bad = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(given, given[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, dup, cut, bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(3)
    rows, copies = [], []
    for c in [*range(25), None]:
        given = talk(r, r.choice([0, 1, 3, 8, 8, 60]))
        rows += [(c, t, role if r.random() < 0.95 else None, text if r.random() < 0.95 else None) for t, role, text in given]
    rows += [(50, i // 3, "user", "same.") for i in range(40)] + [(51, 1, "user", "x" * 50_000 + "."), (52, None, None, None), (53, None, "user", "a.")]
    copies = [r.choice([1, 1, 1, 1, 0, 2, 5]) for _ in rows]
    copies[-1] = 0
    return rows, copies


def frame(spark, talks):
    rows, copies = talks
    return spark.createDataFrame([(*a, n) for a, n in zip(rows, copies)], "conv_id long, turn long, role string, text string, copies int")


def collected(rows) -> list[tuple]:
    return sorted((tuple(x) for x in rows.collect()), key=str)


def test_one_piece_per_conversation(spark, talks):
    given = frame(spark, talks)
    for name in ("piece", "of", "times", "place", "cost", "forced", "name", "n", "start"):
        given = given.withColumn(name, F.lit("x"))
    pieces = conv.repaired_pieces(given, F.col("copies"))
    assert pieces.where("of > 1").count() == 0
    assert collected(conv.report(given, F.col("copies"))) == expected(*talks)
    assert conv.report(given.limit(0)).count() == 0 == conv.repaired_pieces(given.limit(0)).count()


def test_many_pieces_give_the_same(spark, talks):
    small = {"piece_rows": 4, "piece_chars": 2000}
    pieces = conv.repaired_pieces(frame(spark, talks), F.col("copies"), **small)
    assert pieces.where("of > 1").count() > 10
    assert collected(conv.report(frame(spark, talks), F.col("copies"), **small)) == expected(*talks)


def test_long_conversation_ends():
    r = random.Random(5)
    rows = talk(r, 30_000)
    got = conv.repair(rows)
    assert got["audit"].translate(str.maketrans("", "", "I")) and len(got["audit"].replace("I", "")) == len(rows)


def test_sql_says_the_same(talks):
    rows, _ = talks
    given = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", given)
    assert sorted(con.execute(oracles.repair_sql()).fetchall(), key=str) == damaged_and_expected([dict(zip(given.columns, r)) for r in rows])


def damaged_and_expected(given) -> list[tuple]:
    rows, copies = [], []
    for x in given:
        named = [" " if x[c] is None else x[c] for c in ("conv_id", "turn", "role", "text")]
        k = zlib.crc32(f"{named[0]}:{named[1]}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", named[3]) if k == 2 else named[3]
        rows.append((x["conv_id"], x["turn"], "user" if k == 4 else named[2], text))
        copies.append(0 if k == 0 else 2 if k == 3 else 1)
    return expected(rows, copies)


def test_query_against_whole_audits(spark):
    given = [x.asDict() for x in common.table(spark, SF, "conversations").collect()]
    assert collected(queries.op11_repair(spark, SF)) == damaged_and_expected(given)
