"""Personal data: pattern spans, widened by bootstrapped contextual extraction.

Seeds are the entities that fixed patterns find. The words around them form lexical patterns: two words to
the left, two to the right, one on each side. A bipartite graph joins patterns with the identifiers they
surround, seeds and unknown candidates alike, and is scored in rounds: a pattern is trusted for a kind by
the share of its known identifiers of that kind, an unknown candidate by the patterns around it, and trusted
candidates count as known in the next round. Identifiers are counted once however often a text is copied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from joulegrid.llm.common import arrow_rows, discard, stored, texts

# fixed values: kinds in order and their patterns, written so that a long run is scanned once
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# forms that could be identifiers though no base pattern takes them
_MORE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,64}){0,8}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])"),
    "number": re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9()./\x20-]{5,40}[0-9](?![0-9A-Za-z])"),
}
ROUNDS = 3
SUPPORT = 6.0
TRUST = 0.75
ACCEPT = 0.85
DOUBT = 1.5
UNKNOWN = 0.1
CONTEXT = 64
_MENTION = "struct<kind:int,start:int,end:int,value:string,state:int,patterns:array<string>>"
SEED, CANDIDATE, FAILED = 0, 1, 2


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at-sign with a local part before it and a dotted domain after it, left to right."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        else:
            free = at + 1  # no later match can start before this sign
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base spans in order, and of matches that failed their check in earnest."""
    good, failed = [], []
    if "@" in text:
        good += [(0, a, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            (good if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")) else failed).append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19:
            (good if _luhn(digits) else failed).append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (good if 9 <= len(_digits(m[0])) <= 15 else failed).append((3, *m.span()))
    return good, failed


def _candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of unknown identifiers clear of ``taken``."""
    found = []
    if "@" in text or "at)" in text or "at]" in text:
        found += [(0, *m.span()) for m in _MORE["email"].finditer(text)]
    if text.count(":") > 2:
        found += [(1, *m.span()) for m in _MORE["ip"].finditer(text)]
    for m in _MORE["number"].finditer(text):
        n = len(_digits(m[0]))
        if 7 <= n <= 19:
            found.append((3 if n < 13 else 2, *m.span()))
    if not found:
        return []
    spans = sorted((a, b) for _, a, b in taken)
    clear = []
    for kind, start, end in found:
        if not any(a < end and start < b for a, b in spans):
            clear.append((kind, start, end))
            spans.append((start, end))
    return clear


def _patterns(text: str, start: int, end: int) -> list[str]:
    clean = lambda words: [w.strip(".,;:!?()[]\"'").lower() for w in words]
    left, right = clean(text[max(0, start - CONTEXT) : start].split()[-2:]), clean(text[end : end + CONTEXT].split()[:2])
    made = []
    if len(left) == 2:
        made.append("l " + " ".join(left))
    if left and right:
        made.append(f"m {left[-1]} {right[0]}")
    if len(right) == 2:
        made.append("r " + " ".join(right))
    return made


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, mentions): base spans, failed matches and candidates of every whole text, with contexts."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = []
            for text in texts(batch):
                good, failed = base_spans(text)
                states = [(SEED, good), (FAILED, failed), (CANDIDATE, _candidates(text, good + failed))]
                out.append([
                    {"kind": k, "start": a, "end": b, "value": text[a:b].lower(), "state": state, "patterns": _patterns(text, a, b)}
                    for state, spans in states for k, a, b in spans
                ])
            yield {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "mentions": out}

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string"))
    return arrow_rows(source, f"doc_id long, text_key long, mentions array<{_MENTION}>", body)


def discovered(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, confidence) of the unknown identifiers that trusted patterns surround.

    Works on distinct (pattern, identifier) edges. Sums per pattern and per identifier combine before each
    shuffle; the joins between them split a pattern with very many identifiers.
    """
    each = found.select(F.explode("mentions").alias("m")).select("m.kind", "m.value", "m.state", F.explode("m.patterns").alias("pattern"))
    edges = stored(each.distinct())
    known = None
    for _ in range(rounds):
        believed = F.when(F.col("state") == SEED, 1.0).otherwise(0.0)
        scored = edges
        if known is not None:
            scored = edges.join(known, ["value", "kind"], "left")
            believed = F.when(F.col("state") == SEED, 1.0).when(F.col("state") == CANDIDATE, F.coalesce("confidence", F.lit(0.0))).otherwise(0.0)
        scored = scored.withColumn("_b", believed)
        sums = scored.groupBy("pattern").agg(
            *[F.sum(F.when(F.col("kind") == k, F.col("_b")).otherwise(0.0)).alias(f"p{k}") for k in range(len(KINDS))],
            F.sum((F.col("state") == FAILED).cast("double")).alias("failed"),
            F.sum(F.when(F.col("state") == CANDIDATE, 1 - F.col("_b")).otherwise(0.0)).alias("unknown"),
        )
        total = sum((F.col(f"p{k}") for k in range(len(KINDS))), F.col("failed")) + UNKNOWN * F.col("unknown") + DOUBT
        kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"p{k}").alias("positive"), (F.col(f"p{k}") / total).alias("trust")) for k in range(len(KINDS))]))
        trusted = sums.select("pattern", kinds.alias("k")).select("pattern", "k.*").where((F.col("positive") >= SUPPORT) & (F.col("trust") >= TRUST))
        around = edges.where(F.col("state") == CANDIDATE).join(trusted.select("pattern", "kind", "trust"), ["pattern", "kind"])
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("trust")))))
        now = stored(around.groupBy("value", "kind").agg((1 - doubt).alias("confidence")).where(F.col("confidence") >= ACCEPT))
        if known is not None:
            discard(known)
        known = now
    return known


def _extra_spans(found: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_key, extra): spans of discovered identifiers per text."""
    open_mentions = found.select("doc_id", "text_key", F.explode("mentions").alias("m")).where(F.col("m.state") == CANDIDATE)
    met = open_mentions.select("doc_id", "text_key", "m.kind", "m.value", "m.start", "m.end").join(known.select("value", "kind"), ["value", "kind"], "left_semi")
    return met.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(F.array_sort(spans), one))


def _with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.join(extra, same, "left").drop("_id", "_key").withColumn("extra", F.coalesce("extra", none))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) for every row.

    The counts and the digest are of the base spans; ``spans`` lists all, ``n_found`` counts those that the
    contexts added. NULL and empty texts have none. Repeated rows are reported one by one, extra columns are
    ignored, an empty table gives no rows.
    """
    found = stored(mentions(docs))
    rows = _with_extra(found, _extra_spans(found, discovered(found)))
    plain = lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    base = F.transform(F.filter("mentions", lambda m: m["state"] == SEED), plain)
    rows = rows.withColumn("_base", base)
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.concat("_base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_found"),
    )


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced together."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start < at:
            if end > at:
                at = end
            continue
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """All documents with personal data replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``.

    Keeps the columns; ``n_chars``, where there is one, follows the new text. NULL texts stay NULL.
    """
    found = stored(mentions(docs))
    extra = stored(_extra_spans(found, discovered(found)))  # its size is then known when the join is planned
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    rows = _with_extra(keyed, extra).select("_row", "text", "extra")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            made = []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("extra").to_pylist()):
                spans = base_spans(text or "")[0] + [(m["kind"], m["start"], m["end"]) for m in more]
                made.append(_masked(text, spans) if spans else text)
            yield {"_row": batch.column("_row"), "_text": made}

    out = arrow_rows(rows, rows.select("_row", F.lit(None).cast("string").alias("_text")).schema, body)
    new = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
