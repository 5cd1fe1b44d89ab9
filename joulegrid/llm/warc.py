"""WARC derivatives: linked metadata and plain-text conversion records of HTTP responses.

Every response gives one ``metadata`` and one ``conversion`` record. Both refer to the response by its
record id (``WARC-Refers-To``), repeat its target address and date, carry the response's own digests, and
have a digest and length of their own block. Record ids follow from the response's id, so a second run
writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from joulegrid.llm.common import arrow_rows

# fixed values of the WARC format
VERSION = "WARC/1.1"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_BREAK = "\r\n"
# Openers only: what closes them is looked for once, so a page of unclosed ones is read once as well.
_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|head)\b", re.I)
_CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "head", "title")}
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>", re.I)
_ANCHOR, _ROOT = re.compile(r"<a\b", re.I), re.compile(r"<html\b", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_SPACE = re.compile(r"[ \t\r\f\v]+")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '\n'.join(parts))}>"


def _shown(page: str) -> str:
    """The page without comments and hidden elements; one that is never closed stays, as text."""
    out, at, unclosed = [], 0, set()
    start = at
    while m := _HIDDEN.search(page, start):
        name = (m[1] or "").lower()
        end = -1
        if name not in unclosed:
            if name:
                opened = page.find(">", m.end())
                closed = _CLOSERS[name].search(page, opened + 1) if opened >= 0 else None
                end = closed.end() if closed else -1
            else:
                closed_at = page.find("-->", m.end())
                end = closed_at + 3 if closed_at >= 0 else -1
        if end < 0:
            unclosed.add(name)  # nor is any later one
            start = m.end()
            continue
        out.append(page[at : m.start()])
        at = start = end
    return "".join(out) + page[at:]


def plain_text(page: str) -> str:
    """The visible text: scripts, styles, comments and the head go, block tags end lines, entities are decoded."""
    body = _shown(page)
    ended = body.rfind(">") + 1  # nothing after it is a tag
    body = _TAG.sub("", _BLOCK.sub("\n", body[:ended])) + body[ended:]
    lines = (_SPACE.sub(" ", line).strip() for line in html.unescape(body).split("\n"))
    return "\n".join(line for line in lines if line)


def _attributes(page: str, opener: re.Pattern, attribute: re.Pattern) -> Iterator[re.Match]:
    """The attribute of every tag that has it; tags and attributes are each looked for once, going forward."""
    at, ended, found = 0, -1, None
    while tag := opener.search(page, at):
        if ended < tag.end():
            ended = page.find(">", tag.end())
            ended = len(page) if ended < 0 else ended
        if found is None or found.start() < tag.end():
            found = attribute.search(page, tag.end())
            if found is None:
                return
        if found.start() < ended:
            yield found
            at = found.end()
        else:
            at = ended


def links(page: str) -> list[str]:
    return [html.unescape(next(filter(None, m.groups()), "")) for m in _attributes(page, _ANCHOR, _HREF)]


def language(page: str) -> str:
    return next((m[1] for m in _attributes(page, _ROOT, _LANG)), "")


def title(page: str) -> str:
    opened = _TITLE.search(page, 0, page.rfind(">") + 1)
    closed = _CLOSERS["title"].search(page, opened.end()) if opened else None
    return " ".join(html.unescape(page[opened.end() : closed.start()]).split()) if closed else ""


def _address(url: str) -> str:
    """An address fit for a header line: control characters are written as percent codes."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", headers: str | None = None) -> DataFrame:
    """(page_id, record_id, target_uri, date, content_type, payload_digest, headers, payload): response records of raw pages.

    ``headers`` names a column with a map of the response's own header lines. The record id follows from page, address
    and payload. Control characters of an address become percent codes, a NULL address or page is empty, columns
    beside page_id, url, html and ``headers`` are ignored.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, pages_ = batch.column("page_id").to_pylist(), batch.column("html").to_pylist()
            urls = [_address(u or "") for u in batch.column("url").to_pylist()]
            digests = [digest((p or "").encode("utf-8", "surrogatepass")) for p in pages_]
            yield {
                "page_id": batch.column("page_id"), "record_id": [record_id("response", str(i), u, d) for i, u, d in zip(ids, urls, digests)],
                "target_uri": urls, "date": [date] * len(ids), "content_type": ["text/html"] * len(ids),
                "payload_digest": digests, "headers": batch.column("headers"), "payload": [p or "" for p in pages_],
            }

    lines = F.col(headers) if headers else F.lit(None)
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), lines.cast("map<string,string>").alias("headers"))
    return arrow_rows(source, "page_id long, record_id string, target_uri string, date string, content_type string, payload_digest string, headers map<string,string>, payload string", body)


_HEADERS = ["record_id", "refers_to", "target_uri", "date", "refers_to_date", "content_type", "source_content_type", "source_payload_digest", "block_digest"]


def derivatives(found: DataFrame) -> DataFrame:
    """Two records per response: its metadata and its plain text.

    Columns: page_id, record_type, record_id, refers_to, target_uri, date, refers_to_date, content_type,
    source_content_type, source_payload_digest, block_digest, content_length (long) and block. The metadata has
    a line for every header line of the source. Empty payloads give empty texts; a page that repeats gives the same
    records again; other columns are ignored; an empty table gives none.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ["page_id", "record_type", *_HEADERS, "content_length", "block"]}
            for r in batch.to_pylist():
                page, text = r["payload"], plain_text(r["payload"])
                fields = [("title", title(page)), ("language", language(page)), ("text-digest", digest(text.encode("utf-8", "surrogatepass")))]
                fields += [("source-header", " ".join(f"{k}: {v or ''}".split())) for k, v in sorted(r["headers"] or [])]
                fields += [("outlink", " ".join(link.split())) for link in links(page)]
                meta = "".join(f"{k}: {v}{_BREAK}" for k, v in fields)
                for kind, media, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain", text)):
                    data = block.encode("utf-8", "surrogatepass")
                    line = (r["page_id"], kind, record_id(kind, r["record_id"]), r["record_id"], r["target_uri"], r["date"], r["date"], media, r["content_type"], r["payload_digest"], digest(data), len(data), block)
                    for name, value in zip(out, line):
                        out[name].append(value)
            yield out

    kind = "page_id long, record_type string, " + ", ".join(f"{h} string" for h in _HEADERS) + ", content_length long, block string"
    return arrow_rows(found.select("page_id", "record_id", "target_uri", "date", "content_type", "payload_digest", "headers", "payload"), kind, body)


def serialized(records: DataFrame) -> DataFrame:
    """One column ``value``: the records in WARC form without the blank lines that end them."""
    named = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"),
        ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"),
        ("WARC-Source-Payload-Digest", "source_payload_digest"), ("WARC-Source-Content-Type", "source_content_type"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    head: list[Column] = [F.lit(VERSION + _BREAK)]
    for name, column in named:
        head += [F.lit(f"{name}: "), F.col(column).cast("string"), F.lit(_BREAK)]
    return records.select(F.concat(*head, F.lit(_BREAK), F.col("block")).alias("value"))


def write(records: DataFrame, path: str) -> None:
    """WARC files by Spark's own writer and commit protocol: a lost task leaves no half file."""
    serialized(records).write.option("lineSep", _BREAK + _BREAK).option("compression", "gzip").text(path)


def parsed(data: bytes) -> Iterator[dict[str, str]]:
    """The records of one WARC file, by content length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode().split(_BREAK)
        record = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head[1:])
        start = end + 4
        stop = start + int(record["Content-Length"])
        yield record | {"version": head[0], "block": data[start:stop].decode("utf-8", "surrogatepass")}
        at = stop + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """(headers map, block) of the records in gzip WARC files that fit in a task's memory one by one."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import gzip

        for batch in batches:
            for data in batch.column("content").to_pylist():
                found = list(parsed(gzip.decompress(data)))
                yield {"headers": [{k: v for k, v in r.items() if k != "block"} for r in found], "block": [r["block"] for r in found]}

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for columns in body(batches):
            yield {"headers": [list(h.items()) for h in columns["headers"]], "block": columns["block"]}

    return arrow_rows(files, "headers map<string,string>, block string", pairs)
