"""Page scanning beside plain patterns and on hostile pages; models beside their formulas."""

from __future__ import annotations

import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from joulegrid.llm import common, quality, quality_rules, tokencount, toxicity, warc

SF = "/root/testdata/sf0.001"

# the same rules as plain patterns, which are slow on pages of unclosed tags
HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template|head)\b[^>]*>.*?</\1\s*>", re.S | re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
PIECES = [
    "<!--", "-->", "<script>", "</script>", "<SCRIPT src=x>", "</script >", "<style", "</style>", "<head>", "</head>", ">", "<a ", "href=", "href = 'x y'", 'href="u>v"', "href=z",
    "<a title='x<y' href='q'>", "<title>", "</title>", "<title lang=x>", "<html lang=de>", "<html ", "lang='fr'", "<p>", "</p>", "<b", "text", " ", "\n", "&amp;", "<", "'", '"', "<!doctype html>", "<template>",
]


def plain(page):
    body = warc._BLOCK.sub("\n", HIDDEN.sub("", page))
    lines = (warc._SPACE.sub(" ", line).strip() for line in html.unescape(warc._TAG.sub("", body)).split("\n"))
    return "\n".join(line for line in lines if line)


def test_pages_read_as_by_plain_patterns(spark):
    r = random.Random(1)
    pages = ["".join(r.choice(PIECES) for _ in range(r.randrange(1, 25))) for _ in range(6000)]
    pages += [row["html"] or "" for row in common.table(spark, SF, "pages").collect()]
    for page in pages:
        assert warc.plain_text(page) == plain(page), page
        assert warc.links(page) == [html.unescape(next(filter(None, m.groups()), "")) for m in LINK.finditer(page)], page
        found = TITLE.search(page)
        assert warc.title(page) == (" ".join(html.unescape(found[1]).split()) if found else ""), page
        lang = LANG.search(page)
        assert warc.language(page) == (lang[1] if lang else ""), page


@pytest.mark.parametrize("piece", ["<!--x", "<a x ", "<a>", "<script>", "<title>", "<title ", "<html ", "<a href=\"", "<", "<p ", "</script ", "<head><style>", "lang=", "<a title='<' "])
def test_hostile_pages_end(piece):
    page = piece * (1_000_000 // len(piece)) + " href=x"
    begun = time.perf_counter()
    warc.plain_text(page), warc.links(page), warc.title(page), warc.language(page)
    assert time.perf_counter() - begun < 20


def test_records_carry_headers_and_forge_none(spark):
    rows = [(1, "http://a/\r\nWARC-Type: request", "<p>x", {"server": "s", "x-y": "a\r\nb"}), (2, "u", "one", None), (2, "u", "two", {"etag": None})]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, http map<string,string>")
    found = warc.derivatives(warc.responses(pages, headers="http"))
    got = found.collect()
    assert len({r["record_id"] for r in got}) == 6 and len({r["refers_to"] for r in got}) == 3
    meta = {r["page_id"]: r["block"] for r in got if r["record_type"] == "metadata" and r["page_id"] == 1}[1]
    assert "source-header: server: s\r\n" in meta and "source-header: x-y: a b\r\n" in meta
    for line in warc.serialized(found).collect():
        record = next(warc.parsed(line["value"].encode() + b"\r\n\r\n"))
        assert record["WARC-Type"] in ("metadata", "conversion") and "\n" not in record["WARC-Target-URI"]


def test_rates_leave_the_document_out(spark):
    r = random.Random(4)
    rows = [(i, f"h{r.randrange(4)}" if i % 11 else None, f"p{r.randrange(3)}", r.uniform(-4, 4)) for i in range(300)] + [(900, "alone", "p", -3.0)]
    evidence = spark.createDataFrame(rows, "doc_id long, host string, path string, _llr double").cache()
    got = {x["doc_id"]: x for x in quality.posterior(evidence, quality.sites(evidence)).collect()}
    soft = {i: round(1e6 / (1 + np.exp(-llr))) / 1e6 for i, _, _, llr in rows}
    mean = sum(soft.values()) / len(rows)

    def strength(groups, above):
        n = np.array([len(g) for g in groups])
        good = np.array([sum(soft[i] for i in g) for g in groups])
        m = np.array(above)
        v, within = (n * (good / n - m) ** 2).sum() / n.sum(), (n * m * (1 - m)).sum() / n.sum()
        return float(np.clip(within / max(v - within * len(n) / n.sum(), 1e-9) - 1, 1, 1e6))

    hosts, paths = {}, {}
    for i, h, p, _ in rows:
        hosts.setdefault(h, []).append(i)
        paths.setdefault((h, p), []).append(i)
    kh = strength(list(hosts.values()), [mean] * len(hosts))
    above = {h: (sum(soft[i] for i in g) + kh * mean) / (len(g) + kh) for h, g in hosts.items()}
    kp = strength(list(paths.values()), [above[h] for h, _ in paths])
    for i, h, p, llr in rows:
        others = [soft[j] for j in hosts[h] if j != i]
        host = (sum(others) + kh * mean) / (len(others) + kh)
        near = [soft[j] for j in paths[h, p] if j != i]
        rate = min(0.999, max(0.001, (sum(near) + kp * host) / (len(near) + kp)))
        assert got[i]["path_rate"] == pytest.approx(rate, abs=1e-9)
        assert got[i]["p_good"] == pytest.approx(1 / (1 + np.exp(-llr - np.log(rate / (1 - rate)))), abs=1e-9)
    assert got[900]["path_rate"] == pytest.approx(mean, abs=1e-9)  # nothing but the corpus speaks for it


def test_severity_is_the_sum_over_thresholds(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for row in toxicity.severity(docs, model).collect():
        found, words = toxicity.counts(texts[row["doc_id"]], model.features, {})
        ids, xs = toxicity.values(found, words) if found else ([], [])
        score = sum(model.weights[i] * x for i, x in zip(ids, xs))
        chances = model.above(np.array([score]))[0]
        assert row["expected_severity"] == pytest.approx(chances.sum()) and (np.diff(chances) <= 1e-12).all()
        assert row["grade"] == (chances > 0.5).sum() and row["p_toxic"] == pytest.approx(chances[0])


def test_grades_outside_are_not_used(spark):
    docs = spark.createDataFrame([(i, ("awful nasty words " if i % 2 else "calm kind words ") * (i % 5 + 1)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None if i % 7 == 0 else 9 if i % 7 == 1 else (i % 2) * 2) for i in range(60)], "doc_id long, toxic int, g int")
    model = toxicity.fit(docs, labels, grade="g")
    rows = {r["doc_id"]: r["expected_severity"] for r in toxicity.severity(docs, model).collect()}
    assert min(rows[i] for i in rows if i % 2) > max(rows[i] for i in rows if i % 2 == 0)
    assert toxicity.severity(docs, toxicity.fit(docs, labels.withColumn("g", F.lit(None).cast("int")), grade="g")).count() == 60


def test_small_cells_lean_on_the_level_above(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" * r.randrange(2, 9) for _ in range(80)), "en" if i % 3 else "de", f"s{0 if i < 280 else 1}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = quality_rules.measured(docs)
    levels = {(x["level"], x["lang"], x["source"]): x for x in quality_rules.fences(quality_rules.sketches(measured)).collect()}
    k = quality_rules.PRIOR
    for cell in quality_rules.thresholds(measured).collect():
        for m in quality_rules.METRICS:
            own, lang, whole = levels[2, cell["lang"], cell["source"]], levels[1, cell["lang"], None], levels[0, None, None]
            above = (lang["n"] * lang[f"fence_{m}"] + k * whole[f"fence_{m}"]) / (lang["n"] + k)
            assert cell[f"fence_{m}"] == pytest.approx((own["n"] * own[f"fence_{m}"] + k * above) / (own["n"] + k))


def test_long_pretokens_meet_their_counts_in_the_join(spark, monkeypatch):
    rows = [(1, "abc " * 50 + "x" * 500), (2, "x" * 500 + " abc"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs).collect()}
    monkeypatch.setattr(tokencount, "KNOWN_BYTES", 0)  # everything goes through the join
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs).collect()} == want
