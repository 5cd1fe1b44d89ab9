"""Conversation structure repair by Hirschberg's divide and conquer.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant. Four states
read it: START, SYSTEM, USER, ASSISTANT. Every row is kept (K), given the role that fits (R) or deleted (D); empty
turns may be inserted (I). From the start a vector of the least costs to stand in each of the four states is carried
forward to the middle of the conversation, from the end one is carried backward; they meet in the state with the
least sum, and both halves are solved between known states. Only vectors are held, never a table of all rows.

Of equally cheap repairs the one with the least audit, in ASCII, is chosen. The forward vector carries the order of
the least audits of its four states. Audits that lead to different states after the same row differ before either of
them ends, so that order alone decides the crossing.

A conversation longer than ``piece_rows`` or ``piece_chars`` is never in one task: it is cut into pieces, every piece
is reduced to its least costs from each state to each state, the pieces of a conversation meet as elements of the
same divide and conquer, and are then solved apart between the states found. The result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from joulegrid.llm.common import arrow_rows, stored

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
PIECE_ROWS, PIECE_CHARS = 50_000, 64 << 20
# turns to insert between two states, and after the last row
_INSERTED = (((0, 0), (2, 1), (3, 2)), ((1, 0), (2, 1), (3, 2)), ((2, 0), (3, 1)), ((3, 0), (2, 1)))
_CLOSING = (0, 2, 1, 0)
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_LEGAL = {"su", "ua", "au"}
_FAR = 1 << 60

Element = tuple[tuple[int, int, int, int], ...]
Part = "conv_id long, piece long, of long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines long, repaired string"


def steps(initial: str, forced: bool, truncated: bool, times: int = 1) -> tuple[Element, dict[tuple[int, int], str]]:
    """What one row can do: (from, to, cost, order of its edits among those from one state), and the edits.

    ``times`` equal rows that must all be deleted are one element.
    """
    return _steps(initial, forced, truncated, times) if times > 1 else _steps_of_one(initial, forced, truncated)


@lru_cache(maxsize=512)
def _steps_of_one(initial: str, forced: bool, truncated: bool) -> tuple[Element, dict[tuple[int, int], str]]:
    return _steps(initial, forced, truncated, 1)


def _steps(initial: str, forced: bool, truncated: bool, times: int) -> tuple[Element, dict[tuple[int, int], str]]:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for s in range(4):
        for at, inserted in _INSERTED[s]:
            moves = [(at, DELETE * times, "D" * times)]
            if not forced:
                moves += [(_NEXT[initial][at], TRUNCATED * truncated, "K")] if at in _NEXT.get(initial, ()) else []
                moves += [(_NEXT[i][at], REROLE + TRUNCATED * truncated, "R") for i in "ua" if at in _NEXT[i]]
            for to, cost, edit in moves:
                one = (cost + INSERT * inserted, "I" * inserted + edit)
                best[s, to] = min(best.get((s, to), one), one)
    order = {(s, to): sum(best[s, other][1] < edit for other in range(4) if (s, other) in best) for (s, to), (_, edit) in best.items()}
    return tuple((s, to, cost, order[s, to]) for (s, to), (cost, _) in best.items()), {k: edit for k, (_, edit) in best.items()}


def forward(elements: list[Element], lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Least cost to reach every state after elements lo..hi, and the order of the least audits."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[start] = 0
    for i in range(lo, hi):
        reached, key = [_FAR] * 4, [0] * 4
        for s, to, c, order in elements[i]:
            v = cost[s] + c
            if v < reached[to] or (v == reached[to] and v < _FAR and rank[s] * 4 + order < key[to]):
                reached[to], key[to] = v, rank[s] * 4 + order
        cost = reached
        for place, state in enumerate(sorted(range(4), key=key.__getitem__)):
            rank[state] = place
    return cost, rank


def backward(elements: list[Element], lo: int, hi: int, end: int) -> list[int]:
    """Least cost from every state before elements lo..hi to ``end`` after them."""
    cost = [_FAR] * 4
    cost[end] = 0
    for i in range(hi - 1, lo - 1, -1):
        needed = [_FAR] * 4
        for s, to, c, _ in elements[i]:
            v = cost[to] + c
            if v < needed[s]:
                needed[s] = v
        cost = needed
    return cost


def _cross(elements: list[Element], states: list[int], lo: int, hi: int) -> None:
    if hi - lo < 2:
        return
    middle = (lo + hi) // 2
    cost, rank = forward(elements, lo, middle, states[lo])
    rest = backward(elements, middle, hi, states[hi])
    states[middle] = min(range(4), key=lambda s: (cost[s] + rest[s], rank[s]))
    _cross(elements, states, lo, middle)
    _cross(elements, states, middle, hi)


def crossings(elements: list[Element], start: int = START, end: int | None = None) -> tuple[list[int], int]:
    """The states before, between and after the elements on the cheapest path with the least audit; its cost.

    Without ``end`` the path ends where few insertions close it.
    """
    states = [start] + [0] * len(elements)
    cost, rank = forward(elements, 0, len(elements), start)
    total = [cost[s] + (INSERT * _CLOSING[s] if end is None else _FAR * (s != end)) for s in range(4)]
    states[-1] = min(range(4), key=lambda s: (total[s], rank[s]))
    _cross(elements, states, 0, len(elements))
    return states, total[states[-1]]


def is_blank(text: str) -> bool:
    return not text.strip(SPACE)


def is_truncated(text: str) -> bool:
    return text.rstrip(SPACE)[-1:] not in (".", "!", "?")


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in _LEGAL for i in range(len(initials) - 1))


def applied(rows: list[tuple[str, str, int]], kinds: list[tuple], states: list[int], closing: bool) -> tuple[str, list[str]]:
    """The audit and the repaired lines of rows (role, text, times) along their states."""
    edits, lines = [], []

    def insert(state: int) -> int:
        lines.append("assistant:" if state == USER else "user:")
        return ASSISTANT if state == USER else USER

    for (role, text, _), kind, s, to in zip(rows, kinds, states, states[1:]):
        word = steps(*kind)[1][s, to]
        edits.append(word)
        while word[0] == "I":
            s, word = insert(s), word[1:]
        if word == "K":
            lines.append(f"{role}:{text}")
        elif word == "R":
            lines.append(("assistant:" if s == USER else "user:") + text)
    s = states[-1]
    for _ in range(_CLOSING[s] if closing else 0):
        edits.append("I")
        s = insert(s)
    return "".join(edits), lines


def repair(rows: list[tuple[int | None, str, str]]) -> dict:
    """Counts, cost, audit and repaired text of one conversation's rows (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    seen: set[tuple[str, str]] = set()
    kinds, faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        fault = "blank" if is_blank(text) else "duplicate" if (role, text) in seen else "truncated" if is_truncated(text) else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        kinds.append((role[:1], True, False) if fault in ("blank", "duplicate") else (role[:1], False, fault is not None))
    states, cost = crossings([steps(*kind)[0] for kind in kinds])
    audit, lines = applied([(role, text, 1) for _, role, text in rows], kinds, states, True)
    return faults | {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "illegal": sum(a[1][:1] + b[1][:1] not in _LEGAL for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit, "lines": len(lines), "repaired": "\n".join(lines),
    }


_FIELDS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "lines", "repaired"]


def _whole(rows: DataFrame) -> DataFrame:
    """One piece for every conversation, streamed from partitions that hold it whole and in order."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out: dict[str, list] = {f: [] for f in _FIELDS}
        held, now, size, begun = [], None, 0, False

        def finish() -> None:
            for k, v in ({"conv_id": now} | repair(held)).items():
                out[k].append(v)

        def flushed() -> dict:
            full = {k: list(v) for k, v in out.items()}
            for v in out.values():
                v.clear()
            return full | {"piece": [0] * len(full["conv_id"]), "of": [1] * len(full["conv_id"])}

        for batch in batches:
            for conv, turn, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
                if not begun or conv != now:
                    if begun:
                        finish()
                    held, now, begun = [], conv, True
                    if size > 1 << 22:
                        yield flushed()
                        size = 0
                held += [(turn, role, text)] * copies
                size += 200 + len(text) * copies
        if begun:
            finish()
            yield flushed()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow_rows(dealt, Part, body)


def _grouped(rows: DataFrame, keys: list[str], schema: str, body) -> DataFrame:
    """``applyInArrow`` whose body takes and gives lists by column."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(body(table.to_pydict()), schema=arrow)

    return rows.groupBy(*keys).applyInArrow(run, schema)


def _expanded(rows: dict) -> tuple[list[tuple[str, str, int]], list[tuple]]:
    """Rows and kinds of a piece in order; of equal rows those after the first are one element."""
    out, kinds = [], []
    for at in np.argsort(rows["place"]).tolist():
        role, times = rows["role"][at], rows["times"][at]
        first = times if rows["forced"][at] else 1
        for n, forced in ((first, rows["forced"][at]), (times - first, True)):
            if n:
                out.append((role, rows["text"][at] if "text" in rows else "", n))
                kinds.append((role[:1], forced, rows["cut"][at] and not forced, n))
    return out, kinds


def _pieced(rows: DataFrame, pieces: int) -> DataFrame:
    """The pieces of long conversations; ``pieces`` bounds the rows of each, not their number."""
    order = ["conv_id", "turn", "role", "text"]
    equal = rows.where("copies > 0").groupBy(*order).agg(F.sum("copies").alias("times"))
    dealt = equal.repartitionByRange(pieces, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    named = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    placed = stored(dealt.select("*", F.shiftright("place", 33).alias("piece"), blank.alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"), named.alias("name")))
    first = placed.groupBy("conv_id", "name").agg(F.min("place").alias("first"))
    same = F.col("p.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("p.name") == F.col("f.name"))
    known = placed.drop("text").alias("p").join(first.alias("f"), same).select("p.*", (F.col("place") > F.col("first")).alias("again"))
    light = stored(known.withColumn("forced", F.col("blank") | F.col("again")))

    def reduced(rows: dict) -> dict:
        _, kinds = _expanded(rows)
        elements = [steps(*kind)[0] for kind in kinds]
        ways = [(s, to, cost[to], rank[to]) for s in range(4) for cost, rank in [forward(elements, 0, len(elements), s)] for to in range(4) if cost[to] < _FAR]
        blank = [n for n, b in zip(rows["times"], rows["blank"]) if b]
        again = [n - (not a) for n, a, b in zip(rows["times"], rows["again"], rows["blank"]) if not b]
        cut = [1 for f, c in zip(rows["forced"], rows["cut"]) if c and not f]
        initials = [(i, n) for (i, _, _, n) in kinds]
        pairs = sum(a[0] + b[0] not in _LEGAL for a, b in zip(initials, initials[1:])) + sum(n - 1 for _, n in initials)
        return {
            "conv_id": rows["conv_id"][:1], "piece": rows["piece"][:1], "ways": [[x for way in ways for x in way]], "blank": [sum(blank)],
            "duplicate": [sum(again)], "truncated": [sum(cut)], "illegal": [pairs], "first": [initials[0][0]], "last": [initials[-1][0]],
        }

    counted = "conv_id long, piece long, ways array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string"
    parts = stored(_grouped(light.select("conv_id", "piece", "place", "role", "times", "forced", "cut", "blank", "again"), ["conv_id", "piece"], counted, reduced))

    def met(parts: dict) -> dict:
        at = np.argsort(parts["piece"]).tolist()
        now = {k: [v[i] for i in at] for k, v in parts.items()}
        states, cost = crossings([tuple(zip(*[iter(ways)] * 4)) for ways in now["ways"]])
        border = [0] + [int(a + b not in _LEGAL) for a, b in zip(now["last"], now["first"][1:])]
        return {k: now[k] for k in ("conv_id", "piece", "blank", "duplicate", "truncated")} | {
            "illegal": [a + b for a, b in zip(now["illegal"], border)], "cost": [cost] + [0] * (len(at) - 1), "of": [len(at)] * len(at),
            "closing": [False] * (len(at) - 1) + [True], "start": states[:-1], "end": states[1:],
        }

    solved = "conv_id long, piece long, blank long, duplicate long, truncated long, illegal long, cost long, of long, closing boolean, start int, `end` int"
    # a piece is sixteen ways here, whatever its rows
    ends = stored(_grouped(parts, ["conv_id"], solved, met))
    at = F.col("l.place") == F.col("t.place")
    texts = light.select("place", "piece", "conv_id", "role", "times", "forced", "cut").alias("l").join(placed.select("place", "text").alias("t"), at).select("l.*", "t.text")
    here = F.col("r.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("r.piece") == F.col("e.piece"))
    both = texts.alias("r").join(ends.select("conv_id", "piece", "start", "end", "closing").alias("e"), here).select("r.*", "e.start", "e.end", "e.closing")

    def repaired(rows: dict) -> dict:
        out, kinds = _expanded(rows)
        states, _ = crossings([steps(*kind)[0] for kind in kinds], rows["start"][0], rows["end"][0])
        audit, lines = applied(out, kinds, states, rows["closing"][0])
        return {"conv_id": rows["conv_id"][:1], "piece": rows["piece"][:1], "audit": [audit], "lines": [len(lines)], "repaired": ["\n".join(lines)]}

    fixed = _grouped(both, ["conv_id", "piece"], "conv_id long, piece long, audit string, lines long, repaired string", repaired)
    turns = rows.where("copies > 0 AND turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    heads = ends.groupBy("conv_id").agg(F.min("piece").alias("head"))
    out = fixed.alias("x").join(ends.alias("e"), F.col("x.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("x.piece") == F.col("e.piece")))
    out = out.select("e.*", "x.audit", "x.lines", "x.repaired").alias("x").join(heads.alias("h"), F.col("x.conv_id").eqNullSafe(F.col("h.conv_id")))
    out = out.select("x.*", "h.head").alias("x").join(gaps.alias("g"), F.col("x.conv_id").eqNullSafe(F.col("g.conv_id")), "left")
    return out.select(
        "x.conv_id", "piece", "of", F.when(F.col("piece") == F.col("head"), F.coalesce("gaps", F.lit(0))).otherwise(0).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", "lines", "repaired",
    )


def _parts(rows: DataFrame, copies: Column | None, piece_rows: int, piece_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """The conversations of one piece, and the pieces of longer ones where there are any."""
    how_often = (F.lit(1) if copies is None else copies).cast("int")
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *texts, how_often.alias("copies"))
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.length("text") * F.col("copies")).alias("chars"))
    long = stored(sizes.where((F.col("n") > piece_rows) | (F.col("chars") > piece_chars)))
    found = long.agg(F.sum("n"), F.sum("chars"), F.count("*")).first()
    if not found[2]:
        return _whole(rows), None
    same = F.col("r.conv_id").eqNullSafe(F.col("l.conv_id"))
    short = rows.alias("r").join(long.alias("l"), same, "left_anti")
    others = rows.alias("r").join(long.alias("l"), same, "left_semi")
    pieces = found[0] // piece_rows + found[1] // piece_chars + 1
    return _whole(short), _pieced(stored(others), int(pieces))


def repaired_pieces(rows: DataFrame, copies: Column | None = None, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(conv_id, piece, of, gaps, blank, duplicate, truncated, illegal, cost, audit, lines, repaired) of conversations.

    ``rows`` hold conv_id, turn, role and text; ``copies`` says how often each stands there (0: it only names its
    conversation). Rows are ordered by turn, NULL first, then role and text. Nearly all conversations are one piece; of
    longer ones the counts, costs, audits and lines of their pieces add up in order. NULL roles and texts are one
    space; an empty role fits no place. Rows with a NULL conv_id are one conversation. Repeated rows are duplicates,
    other columns are ignored, an empty table gives no rows.
    """
    whole, pieced = _parts(rows, copies, piece_rows, piece_chars)
    return whole if pieced is None else whole.unionByName(pieced)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(rows: DataFrame, copies: Column | None = None, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(conv_id, counts, cost, audit, repaired_sha256): one row per conversation, as :func:`repaired_pieces` cuts them.

    A digest has to read its text from the start, so the pieces of a long conversation stream through one task;
    none of them stays there.
    """
    ones, pieces = _parts(rows, copies, piece_rows, piece_chars)
    whole = ones.select("conv_id", *_COUNTS, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    if pieces is None:
        return whole

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held["conv_id"] != row["conv_id"]:
                    if held is not None:
                        yield closed(held)
                    held = {"conv_id": row["conv_id"], "audit": [], "hash": hashlib.sha256(), "lines": 0} | dict.fromkeys(_COUNTS, 0)
                for c in _COUNTS:
                    held[c] += row[c]
                held["audit"].append(row["audit"])
                if row["lines"]:
                    held["hash"].update(("\n" if held["lines"] else "").encode() + row["repaired"].encode())
                held["lines"] += row["lines"]
        if held is not None:
            yield closed(held)

    def closed(held: dict) -> dict:
        return {c: [held[c]] for c in ("conv_id", *_COUNTS)} | {"audit": ["".join(held["audit"])], "repaired_sha256": [held["hash"].hexdigest()]}

    dealt = pieces.select("conv_id", "piece", *_COUNTS, "audit", "lines", "repaired").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    schema = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return whole.unionByName(arrow_rows(dealt, schema, body))
