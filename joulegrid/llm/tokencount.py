"""Token counts of whole texts from the piece counts of distinct pre-tokens.

A pre-token is a run of spaces with the characters up to the next space or line feed; a line feed stands
alone. No piece of the vocabulary crosses such a border (checked when the model is loaded), so the token
count of a text is the sum over its pre-tokens, and each distinct pre-token is encoded once.

Pre-tokens that make up at least 1 / ``FREQUENT`` of the corpus are by that rule at most ``FREQUENT`` many;
their counts are broadcast and summed while the text is read. The rest meet their counts in a join on the
pre-token, whose keys are then all small.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from joulegrid.llm.common import arrow_rows, stored, texts

# fixed values: SentencePiece writes a space as U+2581 and puts one before a text
_SPACE = "▁"
_PRETOKEN = re.compile(f"{_SPACE}*[^{_SPACE}\n]+|\n|{_SPACE}+")
FREQUENT = 2_000_000
# bytes of a pre-token that may be broadcast
KNOWN_BYTES = 64
LIMIT = 4096
_FLUSH = 300_000


@lru_cache(maxsize=1)
def _processor(model: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if "\n" in piece or _SPACE in piece.lstrip(_SPACE):
            raise ValueError(f"piece {piece!r} crosses the borders of pre-tokens")
    return processor


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pretokens(text: str) -> list[str]:
    return _PRETOKEN.findall(_SPACE + text.replace(" ", _SPACE)) if text else []


def _piece_counts(tokens: list[str], model: str) -> list[int]:
    """Pieces of each pre-token alone: a line feed before it keeps the added first space apart."""
    processor = _processor(model)
    alone = len(processor.encode("\n"))
    return [len(ids) - alone for ids in processor.encode(["\n" + t.replace(_SPACE, " ") for t in tokens], num_threads=1)]


def distinct_pretokens(docs: DataFrame, model: str) -> DataFrame:
    """(pretoken, uses, pieces): every distinct pre-token of the corpus once, with its piece count."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in texts(batch):
                seen.update(pretokens(text))
                if len(seen) > _FLUSH:
                    yield {"pretoken": list(seen), "uses": list(seen.values())}
                    seen.clear()
        yield {"pretoken": list(seen), "uses": list(seen.values())}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"pretoken": batch.column(0), "uses": batch.column(1), "pieces": _piece_counts(batch.column(0).to_pylist(), model)}

    partial = arrow_rows(docs.select(F.col("text").cast("string")), "pretoken string, uses long", counted)
    return arrow_rows(partial.groupBy("pretoken").agg(F.sum("uses").alias("uses")), "pretoken string, uses long, pieces int", pieces)


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    A NULL text counts as empty: no bytes, no tokens. Repeated rows and rows with a NULL doc_id are counted
    one by one, extra columns are ignored, an empty table gives no rows. Special strings are ordinary text.
    """
    spark, model = docs.sparkSession, model or default_model()
    pieces = stored(distinct_pretokens(docs, model))
    total = pieces.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    # a true bound in bytes too: long pre-tokens, whole unspaced texts among them, are left to the join
    known_ones = (F.col("uses") >= max(1.0, total / frequent)) & (F.octet_length("pretoken") <= KNOWN_BYTES)
    often = pieces.where(known_ones).select("pretoken", "pieces").toArrow()
    if often.num_rows > frequent:
        raise AssertionError("more frequent pre-tokens than their bound")
    known = spark.sparkContext.broadcast(dict(zip(often.column(0).to_pylist(), often.column(1).to_pylist())))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        count, at, part = known.value, 0, TaskContext.get().partitionId()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "n_bytes", "n_known", "pretoken", "uses")}

            def add(*values: object) -> None:
                for name, value in zip(out, values):
                    out[name].append(value)

            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                row, own, rest = part << 40 | at, 0, {}
                at += 1
                for token in pretokens(text):
                    n = count.get(token)
                    if n is None:
                        rest[token] = rest.get(token, 0) + 1
                    else:
                        own += n
                # the document's own line joins nothing: its key is no pre-token
                add(row, doc_id, len(text.encode("utf-8", "surrogatepass")), own, f"\n{row}", 0)
                for token, n in rest.items():
                    add(row, doc_id, None, 0, token, n)
            yield out

    kind = "row long, doc_id long, n_bytes long, n_known long, pretoken string, uses int"
    lines = arrow_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), kind, summed)
    joined = lines.join(pieces.where(~known_ones).select("pretoken", "pieces"), "pretoken", "left")
    parts = joined.select("row", "doc_id", "n_bytes", (F.col("n_known") + F.coalesce(F.col("uses") * F.col("pieces"), F.lit(0))).alias("n"))
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
