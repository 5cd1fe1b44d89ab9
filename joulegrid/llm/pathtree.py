"""URL filters by a path-template tree, in DataFrame functions only.

Per host the paths form a tree. Numbers are one shape; a segment with less than a twentieth of its node's pages is
variable and becomes the wildcard. Branches of one node whose labelled pages are blocked at a similar rate (a
chi-square test at 95 %) are merged into one, and the tree goes on below them. Down the tree the share of blocked
pages is smoothed towards that of the node above: host towards corpus, template towards host. Pages whose template
ends above one half are rejected.

Paths are reduced to distinct (host, shape) rows first. A level costs sums per (host, node, segment), a ranking
that cuts every partition to twenty rows per node, and one join of the shapes with their nodes: no host is ever
gathered, however many of the pages it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from joulegrid.llm.common import few_ids, stored

# levels of the tree; what stands deeper is one segment
LEVELS = 8
# a segment is literal if it has at least one in so many of its node's pages; so a node has at most so many
LITERAL = 20
# chi-square at 95 % and one degree of freedom
DIFFERENT = 3.841458820694124
# pages that the share above a node counts for
PRIOR = 4.0
REJECT = 0.5
WILD, REST = "*", "**"
_BROADCAST = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path of an address; both empty without ``://``."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def by_length(rules: list[Rule]) -> list[Rule]:
    """Longest first, as host and path together; equal lengths by name."""
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest of a few configured rules that fits the host or a domain above it and starts the path, else NULL."""
    out = F.lit(None).cast("string")
    for domain, start, _ in reversed(by_length(rules)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, domain + start).otherwise(out)
    return out


def placed(pages: DataFrame, rules: list[Rule], key: str = "page_id") -> DataFrame:
    """(key, host, path, shape, rule, label) for every row; ``label`` is the verdict of its rule."""
    host, path = host_and_path(F.col("url").cast("string"))
    named = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict = F.lit(None).cast("string")
    for domain, start, what in rules:
        verdict = F.when(F.col("rule") == domain + start, what).otherwise(verdict)
    shape = F.regexp_replace(F.replace("path", F.lit("*"), F.lit("%2A")), "[0-9]+", "#")
    return named.select("*", shape.alias("shape"), rule.alias("rule")).select("*", verdict.alias("label"))


def _similar(one: str, two: str) -> str:
    """Whether two branches with l labelled pages, b of them blocked, may have one rate. Unlabelled ones are alike."""
    n, m, a, b = (f"cast({x} as double)" for x in (f"{one}.l", f"{two}.l", f"{one}.b", f"{two}.b"))
    apart, spread = f"({a} * {m} - {b} * {n})", f"(({a} + {b}) * ({n} + {m} - ({a} + {b})))"
    return f"if({one}.l = 0 or {two}.l = 0, {one}.l = {two}.l, {apart} * {apart} * ({n} + {m}) <= {DIFFERENT}D * ({n} * {m}) * {spread})"


def _smoothed(blocked: str, labelled: str, above: str) -> str:
    return f"(cast({blocked} as double) + {PRIOR}D * {above}) / (cast({labelled} as double) + {PRIOR}D)"


def _branches(here: DataFrame) -> DataFrame:
    """(host, node, branches): for every node a map from segment to the name and share of its merged branch."""
    sums = [F.sum(c).alias(c) for c in ("n", "l", "b")]
    kids = here.groupBy("host", "node", "seg").agg(*sums)
    rank = F.row_number().over(Window.partitionBy("host", "node").orderBy(F.col("n").desc(), "seg"))
    largest = kids.withColumn("_rank", rank).where(F.col("_rank") <= LITERAL)
    largest = largest.groupBy("host", "node").agg(F.collect_list(F.struct("seg", "n", "l", "b")).alias("kids"))
    nodes = here.groupBy("host", "node").agg(*sums, F.max("q").alias("q")).join(largest, ["host", "node"])
    nodes = nodes.withColumn("kids", F.expr(f"filter(kids, k -> k.n * {LITERAL} >= n)"))
    rest = {c: F.expr(f"aggregate(kids, {c}, (s, k) -> s - k.{c})") for c in ("n", "l", "b")}
    wild = F.struct(F.lit(WILD).alias("seg"), *[v.alias(c) for c, v in rest.items()])
    nodes = nodes.withColumn("kids", F.when(rest["n"] > 0, F.array_append("kids", wild)).otherwise(F.col("kids")))
    nodes = nodes.withColumn("kids", F.expr("array_sort(transform(kids, k -> named_struct('rate', if(k.l > 0, k.b / k.l, -1D), 'seg', k.seg, 'l', k.l, 'b', k.b)))"))
    # in order of their rates each branch joins the last group or opens one
    last = "element_at(acc, -1)"
    groups = f"""aggregate(kids, cast(array() as array<struct<rep:string,l:bigint,b:bigint,segs:array<string>>>), (acc, k) ->
        if(size(acc) > 0 and coalesce({_similar("try_element_at(acc, -1)", "k")}, false),
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('rep', {last}.rep, 'l', {last}.l + k.l, 'b', {last}.b + k.b, 'segs', array_append({last}.segs, k.seg)))),
           array_append(acc, named_struct('rep', k.seg, 'l', k.l, 'b', k.b, 'segs', array(k.seg)))))"""
    nodes = nodes.withColumn("groups", F.expr(groups))
    entries = f"flatten(transform(groups, g -> transform(g.segs, s -> struct(s, struct(g.rep, {_smoothed('g.b', 'g.l', 'q')} as q)))))"
    return nodes.select("host", "node", F.expr(f"map_from_entries({entries})").alias("branches"))


def tree(rows: DataFrame) -> DataFrame:
    """(host, shape, template, n, l, b, q): the template of every distinct shape and its smoothed share of blocked pages.

    ``rows`` are those of :func:`placed`. Every level is written once.
    """
    shapes = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("label").alias("l"), F.count(F.when(F.col("label") == "block", 1)).alias("b")
    )
    segments = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(shape, 2)"), "/", -1))
    shapes = stored(shapes.withColumn("segs", segments))
    seen = shapes.agg(F.sum("l"), F.sum("b"), F.max(F.size("segs"))).first()
    whole = ((seen[1] or 0) + 1.0) / ((seen[0] or 0) + 2.0)
    hosts = shapes.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    hosts = hosts.select("host", F.expr(_smoothed("hb", "hl", f"cast('{whole!r}' as double)")).alias("q"))
    state = stored(shapes.join(hosts, "host").withColumn("node", F.lit("")))
    ended = [state.where(F.size("segs") == 0)]
    for level in range(1, min(seen[2] or 0, LEVELS) + 1):
        here = state.where(F.size("segs") >= level)
        here = here.withColumn("seg", F.col("segs")[level - 1] if level < LEVELS else F.lit(REST))
        found = F.coalesce(F.try_element_at("branches", F.col("seg")), F.try_element_at("branches", F.lit(WILD)))
        moved = here.join(_branches(here), ["host", "node"]).withColumn("_to", found)
        state = stored(moved.select(
            "host", "shape", "segs", "n", "l", "b", F.col("_to.q").alias("q"), F.concat_ws("/", "node", "_to.rep").alias("node")
        ))
        ended.append(state.where(F.size("segs") == level) if level < LEVELS else state)
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out.select("host", "shape", F.col("node").alias("template"), "n", "l", "b", "q")


def templates(pages: DataFrame, rules: list[Rule], key: str = "page_id") -> DataFrame:
    """(host, template, pages, labelled, blocked, share, verdict): the templates of all hosts."""
    grouped = tree(placed(pages, rules, key)).groupBy("host", "template", "q").agg(*[F.sum(c).alias(c) for c in ("n", "l", "b")])
    verdict = F.when(F.col("q") > REJECT, "block").otherwise("allow")
    return grouped.select(
        "host", "template", F.col("n").alias("pages"), F.col("l").alias("labelled"), F.col("b").alias("blocked"), F.col("q").alias("share"), verdict.alias("verdict")
    )


def judged(pages: DataFrame, rules: list[Rule], key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages`` (key, url).

    ``rules`` are (host, path, allow or block); the longest that fits decides, and its pages are the labelled ones.
    All others get the verdict of their template. A NULL url, or one without ``://``, has an empty host and path, a
    host like any other. A NULL key stays NULL, repeated rows give repeated results, columns beside key and url are
    ignored, an empty table gives no rows. Without any labelled page everything is allowed.
    """
    rows = placed(pages, rules, key)
    address = F.md5(F.concat("host", "shape"))  # a shape is empty or starts with a slash, a host has none
    rejected = stored(tree(rows).where(F.col("q") > REJECT).select(address.alias("_address")))
    both = rows.withColumn("_address", address).join(few_ids(rejected.withColumn("_rejected", F.lit(True)), _BROADCAST), "_address", "left")
    verdict = F.coalesce("label", F.when(F.col("_rejected"), "block").otherwise("allow"))
    return both.select(F.col(key), "host", "path", "rule", verdict.alias("verdict"))
