"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, functions as F

import corpus_pipeline
from joulegrid.llm import decontamination, mixing, pii, quality, quality_rules, simhash, substrings, tokencount, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over the lazy dog while many other animals watch it from afar".split()


def sentence(i: int, n: int) -> str:
    return " ".join(WORDS[(i * 7 + k * (1 + i % 5) + k // 11) % len(WORDS)] + str((i * k) % 13) for k in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, sentence(i, 40 + i), "en", f"s{i % 3}", 1) for i in range(12)]
    rows += [(20, None, "en", "s0", None), (21, "", None, None, 0), (22, " \n\t ", "en", None, 4)]
    rows += [(23, sentence(3, 30_000), "en", "s1", 9)]  # very long
    rows += [(24, rows[0][1], "en", "s2", 1), (1, rows[1][1], "en", "s1", 1)]  # a copy and a repeated row
    rows += [(None, "a text without an id, " + sentence(9, 60), "de", "s0", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(12)] + [(None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, sentence(5, 20)), (2, None), (3, ""), (4, "short")], "item_id long, text string")


def clashing(docs: DataFrame) -> DataFrame:
    """Extra columns under names that the operators use inside."""
    for name in ("size", "fp", "row", "host", "path", "_row", "_llr", "_found", "mentions", "copies", "node", "root", "target", "text_key", "kept", "count"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def plain(rows: DataFrame) -> list[str]:
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows.collect())


def per_row(labels, benchmark):
    return {
        "mix": mixing.mixed,
        "pii": pii.personal_data,
        "toxicity": lambda d: toxicity.severity(d, toxicity.fit(d, labels)),
        "quality": lambda d: quality.scored(d, labels),
        "tokens": tokencount.token_counts,
        "substrings": substrings.repeats,
        "rules": quality_rules.judged,
        "decontamination": lambda d: decontamination.contamination(d, benchmark),
        "simhash": lambda d: simhash.near_duplicates(d, 3),
    }


NAMES = ["mix", "pii", "toxicity", "quality", "tokens", "substrings", "rules", "decontamination", "simhash"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row_and_none_for_none(name, docs, labels, benchmark):
    operator = per_row(labels, benchmark)[name]
    out = operator(docs)
    assert out.count() == docs.count()
    assert operator(docs.limit(0)).count() == 0
    wide = operator(clashing(docs))
    assert wide.columns == out.columns
    assert plain(wide) == plain(out)


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/b", ""), (2, "http://a/b", ""), (None, "x", "<p>hi")], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages.withColumn("block", F.lit(1)))).collect()
    assert len(rows) == 8
    assert {r["block"] for r in rows if r["record_type"] == "conversion"} == {"", "hi"}
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


@pytest.fixture(scope="module")
def folder(tmp_path_factory, labels, benchmark):
    path = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{path}/labels.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edges(spark, name, stage, docs, folder):
    for given in (docs, clashing(docs), docs.limit(0)):
        out = stage(spark, given, folder)
        if name == "mix":
            assert out.columns[: len(given.columns)] == given.columns
        else:
            assert out.columns == given.columns and out.dtypes == given.dtypes
        assert out.count() <= given.count()


def test_pipeline_keeps_one_of_each_group(spark, docs, folder, tmp_path):
    docs.write.parquet(f"{folder}/documents.parquet")
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()]
    assert 24 not in ids and len(ids) == len(set(ids))
