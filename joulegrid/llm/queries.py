"""The registered queries of the training-data operators: production parameters, whole tables, full results."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from joulegrid.llm import (
    conversations, decontamination, mixing, oracles, pathtree, periodic, pii, quality, quality_rules, simhash, substrings, tokencount, toxicity, warc,
)
from joulegrid.llm.common import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's fingerprints are of three-word shingles."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows whose faults are chosen by a hash of conversation and turn; ``copies`` is 0 for dropped, 2 for repeated ones."""
    def shown(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return conversations.report(rows, F.col("copies"))


URL_RULES: list[pathtree.Rule] = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pathtree.judged(table(spark, sf_dir, "pages"), URL_RULES)


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text, by a hash of its id, goes on with one period from some word on. Without an id none does."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.periodic_runs(table(spark, sf_dir, "documents"), planted_period)
    better = "aggregate(runs, runs[0], (m, r) -> if(r.length * m.period > m.length * r.period, r, m))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    best = rows.withColumn("best", F.when(F.size("runs") > 0, F.expr(better)))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix, op2_pii, op3_toxicity, op4_quality, op5_warc, op6_tokens, op7_substrings, op8_rules, op9_decontaminate,
        op10_simhash, op11_repair, op12_urls, op13_runs,
    )
}
ORACLES: dict[str, str] = {
    "op1_mix": oracles.mix_sql(), "op8_rules": oracles.rules_sql(), "op11_repair": oracles.repair_sql(),
    "op12_urls": oracles.urls_sql(URL_RULES),
}
