"""Periodic runs of words: a suffix automaton whose suffix-link tree is accessed once for every word.

Appending word i accesses the path from the state of the prefix to the root. The path falls into segments of one
colour, the place where their strings ended last. The longest string of a segment, of L words, ended last at i - q:
so the L + q words up to i have period q, no smaller one, and can't be longer to the left. Where L reaches q that is
a square; the stretch is a run once the word after i breaks the period. Access recolours the whole path with i.
The colours live in stacks on the heavy paths of the link tree, so an access meets few of them.

The words of a run all stand in windows of :data:`WINDOW` words that occur twice in the text. Stretches of such
windows are found for whole batches of texts by sorting hashes; the automaton is built for each stretch alone, which
holds every run that touches it as a whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from joulegrid.llm.common import arrow_rows, texts

LEAST_WORDS, LEAST_EXPONENT = 24, 3
# A run of period q repeats at least max(LEAST_WORDS - q, (LEAST_EXPONENT - 1) * q) words, never fewer than these.
WINDOW = LEAST_WORDS * (LEAST_EXPONENT - 1) // LEAST_EXPONENT
_BASE = 0x9E3779B97F4A7C15
RUN = "array<struct<start:long,length:long,period:long>>"


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A rolling hash of every window of ``width`` values, by halves."""
    if width == 1:
        return hashes
    half = width // 2
    part = _grams(hashes, half)
    both = part[: len(part) - half] * np.uint64(pow(_BASE, half, 1 << 64)) + part[half:]
    if width % 2:
        both = both[:-1] * np.uint64(_BASE) + hashes[width - 1 :]
    return both


def stretches(batch: list[list[bytes]]) -> list[list[tuple[int, int]]]:
    """Per text the longest stretches [from, to) covered by windows of WINDOW words that occur twice in it.

    Equal hashes of different windows only widen a stretch.
    """
    sizes = np.fromiter(map(len, batch), dtype=np.int64, count=len(batch))
    found: list[list[tuple[int, int]]] = [[] for _ in batch]
    total = int(sizes.sum())
    if total < WINDOW:
        return found
    hashes = np.fromiter(map(hash, itertools.chain.from_iterable(batch)), dtype=np.int64, count=total).view(np.uint64)
    owner = np.repeat(np.arange(len(batch)), sizes)
    at = np.flatnonzero(owner[: total - WINDOW + 1] == owner[WINDOW - 1 :])
    keys = _grams(hashes, WINDOW)[at] ^ (owner[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return found
    at = at[np.isin(keys, np.unique(twice))]
    depth = np.zeros(total + 1, dtype=np.int64)
    depth[at] += 1
    depth[at + WINDOW] -= 1
    inside = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
    cuts = np.flatnonzero((np.diff(inside) > 1) | (np.diff(owner[inside]) > 0)) + 1
    first = np.cumsum(sizes) - sizes
    for part in np.split(inside, cuts):
        text = int(owner[part[0]])
        found[text].append((int(part[0] - first[text]), int(part[-1] - first[text]) + 1))
    return found


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest length and suffix link of every state, and the state of every prefix.

    A state's first transition is in ``word`` and ``to``; only states with several have a dictionary.
    """
    length, link, word, to, ends = [0], [-1], [-1], [0], []
    more: dict[int, dict[int, int]] = {}
    last = 0
    for c in words:
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        word.append(-1)
        to.append(0)
        p = last
        while p >= 0:
            if word[p] == c:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = c, state
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: state}
                elif c in others:
                    q = others[c]
                    break
                else:
                    others[c] = state
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                word.append(word[q])
                to.append(to[q])
                if q in more:
                    more[clone] = dict(more[q])
                link[q] = link[state] = clone
                while p >= 0:
                    if word[p] == c:
                        if to[p] != q:
                            break
                        to[p] = clone
                    elif more.get(p, {}).get(c) == q:
                        more[p][c] = clone
                    else:
                        break
                    p = link[p]
        ends.append(state)
        last = state
    return length, link, ends


def _heads(length: list[int], link: list[int]) -> list[int]:
    """For every state the top of its heavy path in the link tree."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    size, heavy, most = [1] * len(length), [0] * len(length), [0] * len(length)
    for v in reversed(order[1:]):
        p = link[v]
        size[p] += size[v]
        if size[v] > most[p]:
            most[p], heavy[p] = size[v], v
    head = list(range(len(length)))
    for v in order[1:]:
        p = link[v]
        if heavy[p] == v:
            head[v] = head[p]
    return head


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least LEAST_WORDS words and LEAST_EXPONENT periods."""
    length, link, ends = automaton(words)
    head = _heads(length, link)
    # per heavy path its segments (length of the deepest state, last end), the one next to the top last
    colours: dict[int, list[tuple[int, int]]] = {}
    found, n, ratio = [], len(words), LEAST_EXPONENT - 1
    for i, v in enumerate(ends):
        seen = -1
        while v > 0:
            top, deep = head[v], length[v]
            segments = colours.get(top)
            if segments is None:
                colours[top] = [(deep, i)]
            else:
                nearest = segments[-1][1]
                while segments:
                    reach, end = segments[-1]
                    q = i - end
                    # one colour on two heavy paths is one segment; its deeper part came first
                    if end != seen:
                        longest = reach if reach < deep else deep
                        if longest >= ratio * q and longest + q >= LEAST_WORDS and (i + 1 == n or words[i + 1] != words[i + 1 - q]):
                            found.append((i - q - longest + 1, longest + q, q))
                    if reach > deep:
                        break
                    segments.pop()
                    if reach == deep:
                        break
                seen = nearest
                segments.append((deep, i))
            v = link[top]
    return sorted(found, key=lambda r: (r[0], r[2]))


def text_runs(words: list[bytes], parts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The runs of a text whose stretches are ``parts``, by start and period."""
    found = []
    for a, b in parts:
        ids: dict[bytes, int] = {}
        found += [(a + start, size, q) for start, size, q in runs_of([ids.setdefault(w, len(ids)) for w in words[a:b]])]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stand in no run beyond its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, size, q in runs:
        kept[start + q : start + size] = False
    return b" ".join(itertools.compress(words, kept.tolist()))


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs`` (doc_id, text).

    ``runs`` lists start, length and period in words, by start and period; ``collapsed`` is the text reduced to the
    first period of every run. ``rewrite`` may change the words of a text before the search. A NULL or blank text
    has no words and no runs, a NULL doc_id stays NULL, repeated rows give repeated results, columns beside doc_id
    and text are ignored, an empty table gives no rows. Texts are searched whole, whatever their length.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids = batch.column("doc_id")
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts(batch)]
            if rewrite is not None:
                words = [rewrite(i, w) for i, w in zip(ids.to_pylist(), words)]
            runs = [text_runs(w, parts) for w, parts in zip(words, stretches(words))]
            yield {
                "doc_id": ids,
                "n_words": [len(w) for w in words],
                "runs": [[{"start": a, "length": n, "period": q} for a, n, q in found] for found in runs],
                "collapsed": pa.array([collapsed(w, found) for w, found in zip(words, runs)], pa.binary()),
            }

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_rows(rows, f"doc_id long, n_words long, runs {RUN}, collapsed string", body)
