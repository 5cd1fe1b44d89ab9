"""The path-template tree beside its SQL, a brute-force tree and planted templates."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from joulegrid.llm import oracles, pathtree, queries

RULES = queries.URL_RULES


def ruled(host: str, path: str):
    fits = [(d + p, v) for d, p, v in RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute(urls: list) -> list[tuple]:
    """Every node of every host's tree by plain recursion over its pages."""
    rows = []
    for url in urls:
        host, path = parts(url)
        rule, verdict = ruled(host, path)
        shape = re.sub("[0-9]+", "#", path.replace("*", "%2A"))
        rows.append((host, path, rule, verdict, shape[1:].split("/") if shape else []))
    share: dict[int, float] = {}

    def counts(of):
        return sum(rows[i][3] is not None for i in of), sum(rows[i][3] == "block" for i in of)

    def smooth(of, above):
        l, b = counts(of)
        return (b + pathtree.PRIOR * above) / (l + pathtree.PRIOR)

    def grow(of, level, q):
        kids = defaultdict(list)
        for i in of:
            if len(rows[i][4]) < level:
                share[i] = q
            else:
                kids[rows[i][4][level - 1] if level < pathtree.LEVELS else "**"].append(i)
        total = sum(map(len, kids.values()))
        merged = defaultdict(list)
        for seg, inside in kids.items():
            merged[seg if len(inside) * pathtree.LITERAL >= total else "*"] += inside
        ordered = sorted(merged.items(), key=lambda kv: ((lambda l, b: b / l if l else -1.0)(*counts(kv[1])), kv[0].encode()))
        groups: list[list[int]] = []
        for _, inside in ordered:
            if groups:
                (n, a), (m, b) = counts(groups[-1]), counts(inside)
                alike = n == m == 0 if not n or not m else (a * m - b * n) ** 2 * (n + m) <= pathtree.DIFFERENT * n * m * (a + b) * (n + m - a - b)
                if alike:
                    groups[-1] += inside
                    continue
            groups.append(list(inside))
        for group in groups:
            p = smooth(group, q)
            if level == pathtree.LEVELS:
                share.update(dict.fromkeys(group, p))
            else:
                grow(group, level + 1, p)

    l, b = counts(range(len(rows)))
    hosts = defaultdict(list)
    for i, row in enumerate(rows):
        hosts[row[0]].append(i)
    for of in hosts.values():
        grow(of, 1, smooth(of, (b + 1) / (l + 2)))
    return [(h, p, rule, v or ("block" if share[i] > pathtree.REJECT else "allow")) for i, (h, p, rule, v, _) in enumerate(rows)]


def addresses(seed: int, n: int) -> list:
    r = random.Random(seed)
    out = [None, "", "no address", "http://", "HTTP://A.Com?x", "ftp://ORG/", "x://É.org/es/", "a://b://com/fr/", "http://h.com/" + "a/" * 40, "u://h.com//**/*/", "u://org"]
    for _ in range(n):
        host = r.choice(["a.example.com", "b.net", "c.example.org", "Example.org", "shop.com", "notorg", "x.org"])
        segs = [r.choice(["en", "fr", "de", "es", "tag", "*", str(r.randrange(300)), f"w{r.choice('abcdefgh')}{r.choice('xyz')}", "p" + "q" * r.randrange(30)]) for _ in range(r.randrange(0, 11))]
        out.append(f"http://{host}" + "".join("/" + s for s in segs) + r.choice(["", "/", "?q=/fr/", "#/x"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_brute_force_and_sql(spark, seed):
    urls = addresses(seed, 700)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [tuple(x)[1:] for x in pathtree.judged(pages.repartition(5), RULES).orderBy("page_id").collect()]
    want = brute(urls)
    assert got == want
    assert len({v for *_, v in got}) == 2
    given = pages.toPandas()
    con = duckdb.connect()
    con.register("pages", given)
    sql = [tuple(x) for x in con.execute(f"SELECT * EXCLUDE page_id FROM ({oracles.urls_sql(RULES)}) ORDER BY page_id").fetchall()]
    assert sql == want


def test_planted_templates_are_rejected(spark):
    rules = [("shop.net", "/promo/1", "block"), ("shop.net", "/guide/1", "allow")]
    urls = [f"https://shop.net/{kind}/{i}{kind}" for kind in ("promo", "guide") for i in range(1, 400)]
    urls += [f"https://shop.net/about-{i}" for i in range(200)]
    rows = pathtree.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for row in rows:
        assert row["verdict"] == ("block" if "/promo/" in row["path"] else "allow")
    names = {r["template"]: r for r in pathtree.templates(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert sum(r["pages"] for r in names.values()) == len(urls) and any("promo" in t for t in names)


def test_edges(spark):
    rows = [(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.org/x"), (2, None), (3, "http://a.org/" + "x" * 300_000), (4, "http://a.org/" + "9/" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("host", "shape", "n", "q", "node", "seg", "rule", "branches", "label", "verdict"):
        pages = pages.withColumn(name, F.lit("x"))
    out = pathtree.judged(pages, RULES).collect()
    assert len(out) == len(rows) and {r["verdict"] for r in out} == {"allow"}
    assert pathtree.judged(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in pathtree.judged(pages, []).collect()} == {"allow"}
    plan = pathtree.judged(pages, RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan)
