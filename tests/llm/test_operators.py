"""Each operator beside a brute-force version, an exact round trip or held-out labels."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from joulegrid.llm import common, components, decontamination, mixing, pii, quality, quality_rules, simhash, substrings, tokencount, toxicity, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def pandas_docs(docs):
    return docs.toPandas()


def test_components_against_union_find(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix_meets_targets(docs, pandas_docs):
    got = mixing.mixed(docs).toPandas().set_index("doc_id")
    again = mixing.mixed(docs.repartition(7)).toPandas().set_index("doc_id").loc[got.index]
    assert (got["taken"] == again["taken"]).all()
    size = {i: len(WORD.findall(t)) for i, t in zip(pandas_docs.doc_id, pandas_docs.text)}
    assert (got["size"] == [size[i] for i in got.index]).all() and (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "max"), taken=("taken", "sum"))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by.index))}
    full: set[str] = set()
    while True:  # excess reshared by weight until no source is above its limit
        level = (1.5 * by["size"].sum() - sum(2 * by["size"][s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
        new = {s for s in weights if s not in full and level * weights[s] > 2 * by["size"][s]}
        if not new:
            break
        full |= new
    for s in by.index:
        assert math.isclose(by["target"][s], 2 * by["size"][s] if s in full else level * weights[s])
        largest = max(size[i] for i in got.index[got["source"] == s])
        assert abs(by["taken"][s] - by["target"][s]) <= largest / 2


def test_pareto_prefers_large_documents(spark):
    rows = [(i, "a " * (1 + i % 50), f"s{i % 4}") for i in range(4000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    part = got[got["target"] < got["source_size"]]
    low, high = part[part["size"] < 15]["taken"].gt(0).mean(), part[part["size"] > 35]["taken"].gt(0).mean()
    assert low < high
    by = got.groupby("source").agg(target=("target", "max"), taken=("taken", "sum"))
    assert (abs(by["taken"] - by["target"]) / by["target"]).max() < 0.01


def base_by_plain_patterns(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            checks = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 13 <= len(digits) <= 19 and pii._luhn(digits), 9 <= len(digits) <= 15]
            if checks[k]:
                out.append((k, *m.span()))
    return out


def test_base_spans_against_plain_patterns():
    random.seed(1)
    parts = ["a", "b@", ".", "@", "c.d", "1", "22", "255", "256", "4.", "+1", "(", " ", "-", "_", "4242424242424242", "x@y.z", "é", "%", "\n"]
    for _ in range(20_000):
        text = "".join(random.choices(parts, k=random.randrange(15)))
        assert sorted(base_by_plain_patterns(text)) == sorted(pii.base_spans(text)[0]), text
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000):
        pii.base_spans(text)  # long runs stay cheap


def test_contexts_discover_unseen_identifiers(spark):
    known = [(i, f"please call me on +1 (555) {200 + i}-{1000 + i} today about it") for i in range(20)]
    unseen = [(100 + i, f"please call me on 555-{200 + i}-{1000 + i} today about it") for i in range(10)]
    noise = [(200 + i, f"the order number 77{i}-100-{2000 + i} shipped last week") for i in range(10)]
    frame = spark.createDataFrame(known + unseen + noise, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(frame).collect()}
    assert all(got[i]["n_found"] == 1 for i, _ in unseen)
    assert all(got[i]["n_found"] == 0 and got[i]["n_phone"] == 1 for i, _ in known)
    assert all(got[i]["spans"] == "" for i, _ in noise)
    texts = {r["doc_id"]: r["text"] for r in pii.redacted(frame).collect()}
    assert texts[100] == "please call me on <PHONE> today about it" and texts[200] == noise[0][1]


def test_toxicity_on_held_out_labels(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thetas) > 0).all()
    got = toxicity.severity(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    assert got[got.truth == 0]["toxic"].mean() < 0.05
    assert got[got.truth == 1]["toxic"].mean() > 0.5
    assert got[got.truth == 1]["expected_severity"].mean() > 5 * got[got.truth == 0]["expected_severity"].mean()


def test_cumulative_link_recovers_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    score = x @ np.array([2.0, -1.0, 0.0])
    grade = np.searchsorted([-1.0, 0.5, 2.0], score + rng.logistic(size=3000))
    weights, thetas = toxicity.fit_cumulative([[0, 1, 2]] * 3000, x.tolist(), grade, 3, 4)
    assert np.allclose(weights, [2, -1, 0], atol=0.25) and np.allclose(thetas, [-1, 0.5, 2], atol=0.3)


def test_quality_on_held_out_labels(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    got = quality.scored(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0").select("doc_id", "quality"), "doc_id").toPandas()
    assert got[got.quality == 1]["kept"].mean() > 0.98 and got[got.quality == 0]["kept"].mean() < 0.1


def test_sparse_sites_shrink_to_the_whole(spark):
    rows = [("big", "a", 3.0)] * 900 + [("bad", "a", -3.0)] * 300 + [("tiny", "a", -3.0), (None, None, 3.0)]
    got = {r["host"]: r["rate"] for r in quality.sites(spark.createDataFrame(rows, "host string, path string, _llr double")).collect()}
    assert got["big"] > 0.9 and got["bad"] < 0.1 and got["bad"] < got["tiny"] < got["big"]


def test_warc_round_trip(spark, tmp_path):
    page = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><script>x</script></head><body><p>one<br>two &eacute;<a href="/u?a=1&amp;b=2">l</a></body></html>'
    pages = spark.createDataFrame([(1, "http://h/p", page), (2, "http://h/q", "é\r\n\r\nWARC/1.1")], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(pages))
    rows = {(r["page_id"], r["record_type"]): r for r in records.collect()}
    assert rows[1, "conversion"]["block"] == "one\ntwo él"
    assert "outlink: /u?a=1&b=2\r\n" in rows[1, "metadata"]["block"] and "title: A & B\r\n" in rows[1, "metadata"]["block"]
    source = {r["page_id"]: r for r in warc.responses(pages).collect()}
    for (page_id, _), r in rows.items():
        assert r["refers_to"] == source[page_id]["record_id"] and r["source_payload_digest"] == source[page_id]["payload_digest"]
        assert r["block_digest"] == warc.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
    warc.write(records, str(tmp_path / "w"))
    back = {(h["WARC-Record-ID"]): (h, b) for h, b in warc.read(spark, str(tmp_path / "w")).collect()}
    assert len(back) == 4
    for r in rows.values():
        headers, block = back[r["record_id"]]
        assert block == r["block"] and headers["WARC-Refers-To"] == r["refers_to"] and headers["WARC-Type"] == r["record_type"]


def test_token_counts_equal_the_library(spark, docs, pandas_docs):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=tokencount.default_model())
    random.seed(2)
    odd = ["".join(random.choices(" \n\t\r▁a<s>/théé你😀\x00\x85\xa0 .,{}();", k=random.randrange(30))) for _ in range(500)] + ["", " ", "  ", "</s>", "a" * 20_000]
    texts = pandas_docs.text.tolist() + odd
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frequent in (tokencount.FREQUENT, 50):  # nearly all, or nearly none, by the broadcast
        got = {r["doc_id"]: r for r in tokencount.token_counts(frame, frequent=frequent).collect()}
        for i, text in enumerate(texts):
            assert got[i]["n_tokens"] == len(processor.encode(text)), repr(text[:80])
            assert got[i]["n_bytes"] == len(text.encode()) and got[i]["over_limit"] == (got[i]["n_tokens"] > 4096)


def test_chunks_cover_and_resist_insertions():
    random.seed(4)
    text = "".join(random.choices("abcdefghij éü\n", k=50_000))
    ends = substrings.cuts(text)
    lengths = np.diff([0, *ends])
    assert ends[-1] == len(text) and lengths.max() <= substrings.LARGEST and lengths[:-1].min() >= substrings.LEAST
    moved = {e if e <= 1000 else e - 7 for e in substrings.cuts(text[:1000] + "inserts" + text[1000:])}
    assert len(set(ends) - moved) < 10
    assert substrings.cuts("") == []


def test_pieces_of_long_texts_cut_alike(monkeypatch):
    random.seed(5)
    text = "".join(random.choices("abcdefghij ", k=5_000))
    whole = substrings.cuts(text)
    monkeypatch.setattr(substrings, "_PIECE", 300)
    assert substrings.cuts(text) == whole


def test_repeated_passages_are_found(spark):
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefghijklmno", k=random.randrange(2, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(40):
        own = [word() for _ in range(200)]
        rows.append((i, " ".join(own[:100] + ([passage] if i % 4 == 0 else []) + own[100:])))
    rows += [(100, ""), (101, rows[1][1])]
    got = {r["doc_id"]: r for r in substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:40]:
        assert got[i]["repeated"] == (i % 4 == 0 or i == 1)
        if i % 4 == 0:
            start = text.index(passage)
            a, b = map(int, got[i]["spans"].split(":"))
            assert start <= a and b <= start + len(passage) and b - a > len(passage) / 2
    assert sum(got[i]["n_removed_chars"] == 0 for i in range(0, 40, 4)) == 1 and not got[100]["repeated"]


def test_rule_counts_against_plain_loops(docs, pandas_docs):
    got = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    for i, text in zip(pandas_docs.doc_id, pandas_docs.text):
        words = WORD.findall(text)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        r = got[i]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words)) and r["n_repeat_words"] == len(covered)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_sketch_quantiles_and_fallback(spark):
    rows = [(i, "en", "big", 100, 500, i % 100, 0, 0, 10) for i in range(1000)] + [(5000, "en", "few", 100, 500, 0, 0, 0, 10), (5001, None, None, 100, 500, 0, 0, 0, 10)]
    names = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    got = {(r["lang"], r["source"]): r for r in quality_rules.thresholds(spark.createDataFrame(rows, names)).collect()}
    ratio = np.sort([(i % 100) / 500 for i in range(1000)])
    mid, high = ratio[499], ratio[899]
    assert got["en", "big"]["fence_symbol_ratio"] == pytest.approx(high + 3 * (high - mid) + 0.02, rel=0.03)
    assert got["en", "few"]["fence_symbol_ratio"] == pytest.approx(got["en", "big"]["fence_symbol_ratio"], rel=0.03)
    assert (None, None) in got


def edited(text, k):
    out = list(text)
    for _ in range(k):
        p, how = random.randrange(len(out)), random.randrange(3)
        if how == 0:
            out[p] = random.choice("abcdefghij ")
        elif how == 1:
            del out[p]
        else:
            out.insert(p, random.choice("abcdefghij "))
    return "".join(out)


def distance(item, text):
    """Edits of the best place of the item anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j - 1] + (c != d), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def test_decontamination_against_full_alignment(spark):
    random.seed(7)
    benchmark = common.table(spark, SF, "benchmark")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()][:8]
    texts = [r["text"] for r in common.table(spark, SF, "documents").select("text").collect()]
    cases = []
    for _ in range(40):
        i, text = random.choice(items)
        around = random.choice(texts)[:200]
        cases.append(around[:100] + edited(text, random.randrange(0, max(2, len(text) // 8))) + around[100:])
    index = decontamination.index(items)
    allowed = {i: min(int(len(t := decontamination.normal(x).strip()) * decontamination.EDIT_SHARE), (len(t) - 10) // 10) for i, x in items}
    for text, got in zip(cases, decontamination.matches(cases, index)):
        want = {i for i, x in items if distance(decontamination.normal(x).strip(), decontamination.normal(text)) <= allowed[i]}
        assert {m["item_id"] for m in got} == want
        for m in got:
            item = dict(items)[m["item_id"]]
            place = decontamination.normal(text)[m["start"] : m["end"]]
            assert distance(decontamination.normal(item).strip(), place) == m["edits"]
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    few = spark.createDataFrame(items, "item_id long, text string")
    in_one = decontamination.contamination(frame, few).select("doc_id", "contaminated", "item_ids")
    assert {r[0]: r[1] for r in in_one.collect()} == {k: bool(g) for k, g in enumerate(decontamination.matches(cases, index))}


def test_long_texts_in_pieces_and_blocks(spark, monkeypatch):
    text = "x" * 500 + " the needle is a rather long passage of text to find " + "y" * 500
    index = decontamination.index([(1, "The needle is a rather\nlong passage of text to find"), (2, "abc")])
    whole = decontamination.matches([text, "zz abc"], index)
    monkeypatch.setattr(decontamination, "_PIECE", 37)
    assert decontamination.matches([text, "zz abc"], index) == whole and whole[0][0]["edits"] == 0 and whole[1][0]["item_id"] == 2
    frame = spark.createDataFrame([(1, text), (2, "zz abc")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "The needle is a rather\nlong passage of text to find"), (2, "abc")], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 1)
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (1,))
    assert {r["doc_id"]: list(r["item_ids"]) for r in decontamination.contamination(frame, items).collect()} == {1: [1], 2: [2]}


def brute_fingerprint(text):
    words = [w.encode() for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(docs, pandas_docs):
    got = simhash.near_duplicates(docs, 3).toPandas().set_index("doc_id")
    prints = {i: brute_fingerprint(t) for i, t in zip(pandas_docs.doc_id, pandas_docs.text)}
    assert all(got.loc[i, "fingerprint"] == f"{p:016x}" for i, p in prints.items())
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(got.loc[i, "component_id"] == find(i) for i in ids)


def test_links_keep_every_connection(spark):
    random.seed(8)
    seeds = [random.getrandbits(64) for _ in range(20)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(20):
            s ^= 1 << random.randrange(64)
            s ^= 1 << random.randrange(64) if random.random() < 0.5 else 0
            prints.add(s)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    root = {v: v for v in signed.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in ((r["a"], r["b"]) for r in simhash.links(frame).collect()):
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
        root[find(a)] = find(b)
    for p, x in signed.items():
        for q, y in signed.items():
            assert (p ^ q).bit_count() > 2 or find(x) == find(y)


def test_deduplicated_keeps_one_similar_text(spark):
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghijklmno", k=random.randrange(2, 9)))
    rows, truth = [], {}
    for g in range(30):
        base = [word() for _ in range(300)]
        for c in range(3):
            text = base.copy()
            for p in random.sample(range(300), 2 * c):  # at most 20 of 296 shingles change
                text[p] = word()
            rows.append((g * 10 + c, " ".join(text)))
            truth[g * 10 + c] = g * 10
    kept = sorted(r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert set(truth.values()) <= set(kept) and len(kept) <= 34


def test_oracle_texts_agree(spark):
    from oracle_check import difference, oracle_connection

    from joulegrid.llm.queries import ORACLES, QUERIES

    connection = oracle_connection(SF)
    for name, text in ORACLES.items():
        assert difference(QUERIES[name](spark, SF).toPandas(), connection.execute(text).df()) is None, name
