"""SQL that says the same as a registered query, for DuckDB."""

from __future__ import annotations

import math

from joulegrid.llm import conversations as conv, mixing, pathtree, quality_rules as rules

_SPACE = r"\x20\x09-\x0D"


def rules_sql() -> str:
    """``op8_rules``: the counts, the sketch of every metric per cell, its fences and the verdict."""
    metrics = {
        "symbol_ratio": "n_symbols / greatest(1, word_chars)",
        "repeat_ratio": "n_repeat_words / greatest(1, n_words)",
        "dup_line_ratio": "n_dup_lines / (n_lines + 4)",
        "mean_word": "word_chars / greatest(1, n_words)",
        "mean_word_low": "word_chars / greatest(1, n_words)",
    }
    struct = "{'metric': '%s', 'value': CAST(%s AS DOUBLE)}"
    values = ", ".join(struct % item for item in metrics.items())

    def quantile(q: float) -> str:
        at = f"min(CASE WHEN upto >= total * {q!r}::DOUBLE THEN bucket END)"
        return f"CASE WHEN {at} = 0 THEN 0.0 ELSE {rules.LEAST}::DOUBLE * pow({1 + rules.WIDTH}::DOUBLE, {at}) END"

    fences = ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN " + (f"high + {rules.REACH} * (high - mid) + {slack}" if side > 0 else f"low - {rules.REACH} * (mid - low) - {slack}") + f" END) AS f_{m}"
        for m, (side, slack) in rules.METRICS.items()
    )
    prior = f"{rules.PRIOR!r}::DOUBLE"
    upper = {m: f"((l.n * l.f_{m} + {prior} * w.f_{m}) / (l.n + {prior}))" for m in metrics}
    picked = ", ".join(f"(c.n * c.f_{m} + {prior} * {upper[m]}) / (c.n + {prior}) AS f_{m}" for m in metrics)
    inside = " AND ".join(f"CAST({v} AS DOUBLE) {'<=' if rules.METRICS[m][0] > 0 else '>='} f_{m}" for m, v in metrics.items())
    level = "level, lang, source"
    return rf"""
WITH given AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(regexp_extract_all(text, '[^{_SPACE}]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^{_SPACE}]+'), 1) AS i FROM given),
windows AS (SELECT r, i, lead(w, 2) OVER p AS w3, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS g FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM windows WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r),
counts AS (
  SELECT g.doc_id, g.lang, g.source, len(regexp_extract_all(text, '[^{_SPACE}]+')) AS n_words, length(regexp_replace(text, '[{_SPACE}]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines FROM given) g LEFT JOIN covered c ON c.r = g.r),
measured AS (SELECT lang, source, unnest([{values}], recursive := true) FROM counts),
bucketed AS (SELECT lang, source, metric, CASE WHEN value <= {rules.LEAST} THEN 0 ELSE CAST(ceil(ln(value / {rules.LEAST}::DOUBLE) / {float(math.log1p(rules.WIDTH))!r}::DOUBLE) AS INTEGER) END AS bucket FROM measured),
sketches AS (
  SELECT 2 AS level, lang, source, metric, bucket, count(*) AS n FROM bucketed GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM bucketed GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, metric, bucket, count(*) FROM bucketed GROUP BY ALL),
summed AS (SELECT *, sum(n) OVER (PARTITION BY {level}, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {level}, metric) AS total FROM sketches),
quantiles AS (SELECT {level}, metric, CAST(max(total) AS BIGINT) AS n, {quantile(rules.MIDDLE)} AS mid, {quantile(rules.OUTER)} AS high, {quantile(1 - rules.OUTER)} AS low FROM summed GROUP BY {level}, metric),
fences AS (SELECT {level}, max(n) AS n, {fences} FROM quantiles GROUP BY {level}),
cells AS (
  SELECT c.lang, c.source, {picked} FROM fences c
  JOIN fences l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM c.lang JOIN fences w ON w.level = 0 WHERE c.level = 2)
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND {inside} AS kept
FROM (SELECT *, n_words < {rules.FEWEST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS failed FROM counts) d
JOIN cells c ON c.lang IS NOT DISTINCT FROM d.lang AND c.source IS NOT DISTINCT FROM d.source"""


def mix_sql() -> str:
    """``op1_mix``: targets by rising limits, strata from large to small with the carried error, Pareto ranks."""
    weights = ", ".join(map(str, mixing.WEIGHTS))
    u = f"(CAST('0x' || substr(md5(concat('{mixing.SEED}', chr(2), coalesce(CAST(doc_id AS VARCHAR), chr(1)))), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE"
    return rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')) AS size, {u} AS u FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    list_extract([{weights}]::DOUBLE[], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1 AS INTEGER)) AS w FROM docs GROUP BY source),
rising AS (
  SELECT *, source_size * {mixing.CAP}::DOUBLE AS lim, (sum(source_size) OVER () * {mixing.SHARE}::DOUBLE - coalesce(sum(source_size * {mixing.CAP}::DOUBLE) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM sources WINDOW b AS (ORDER BY source_size * {mixing.CAP}::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(lim, coalesce(w * (SELECT arg_min(level, lim / w) FROM rising WHERE level * w < lim), lim)) AS target FROM rising),
groups AS (
  SELECT source, CAST(floor(log2(size) * {mixing.STRATA_PER_OCTAVE}) AS INTEGER) AS k, count(*) AS n, CAST(sum(size) AS BIGINT) AS words, sum(size::DOUBLE * size) AS squares, max(size) AS most
  FROM docs WHERE size > 0 GROUP BY ALL),
rests AS (
  SELECT g.*, t.source_size, t.target, floor(t.target / t.source_size + 1e-9) AS whole, greatest(0.0, t.target - floor(t.target / t.source_size + 1e-9) * t.source_size) AS rest
  FROM groups g JOIN goals t ON t.source IS NOT DISTINCT FROM g.source),
scales AS (
  SELECT *, (rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(squares) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM rests),
fitting AS (SELECT source, max(k) AS first_k, arg_max(s, k) AS scale FROM scales WHERE s >= 0 AND s * most <= 1 GROUP BY source),
plans AS (
  SELECT s.* EXCLUDE (s), coalesce(f.scale, 0.0) AS scale, row_number() OVER (PARTITION BY s.source ORDER BY k DESC) AS nth,
    CASE WHEN k > f.first_k THEN 1.0::DOUBLE ELSE least(1.0, coalesce(f.scale, 0.0) * words / n) END AS p
  FROM scales s LEFT JOIN fitting f ON f.source IS NOT DISTINCT FROM s.source),
carried AS (
  SELECT source, nth, k, greatest(0.0, least(n::DOUBLE, round(p * words / (words / n)))) AS take, p * words - greatest(0.0, least(n::DOUBLE, round(p * words / (words / n)))) * (words / n) AS owed FROM plans WHERE nth = 1
  UNION ALL
  SELECT p.source, p.nth, p.k, greatest(0.0, least(p.n::DOUBLE, round((c.owed + p.p * p.words) / (p.words / p.n)))),
    (c.owed + p.p * p.words) - greatest(0.0, least(p.n::DOUBLE, round((c.owed + p.p * p.words) / (p.words / p.n)))) * (p.words / p.n)
  FROM carried c JOIN plans p ON p.source IS NOT DISTINCT FROM c.source AND p.nth = c.nth + 1),
chances AS (
  SELECT d.*, p.k, p.whole, c.take, p.n, least(1 - 1e-9, greatest(1e-12, p.scale * d.size)) AS q
  FROM docs d JOIN plans p ON p.source IS NOT DISTINCT FROM d.source AND d.size > 0 AND p.k = CAST(floor(log2(d.size) * {mixing.STRATA_PER_OCTAVE}) AS INTEGER)
  JOIN carried c ON c.source IS NOT DISTINCT FROM p.source AND c.nth = p.nth),
ranked AS (SELECT *, rank() OVER (PARTITION BY source, k ORDER BY (u / (1 - u)) * ((1 - q) / q), doc_id NULLS FIRST) AS place FROM chances),
copies AS (SELECT doc_id, source, size, CAST(whole AS BIGINT) + CASE WHEN place <= take THEN 1 ELSE 0 END AS copies FROM ranked
  UNION ALL SELECT doc_id, source, size, 0 FROM docs WHERE size = 0)
SELECT c.doc_id, c.size, g.source_size, g.target, c.copies * c.size AS taken, c.copies FROM copies c JOIN goals g ON g.source IS NOT DISTINCT FROM c.source"""


def urls_sql(url_rules: list[pathtree.Rule]) -> str:
    """``op12_urls``: the tree level by level; the branches of a node join groups by a recursive walk over their ranks."""
    fits = {f"{d}{p}": f"(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}')" for d, p, _ in pathtree.by_length(url_rules)}
    rule = "CASE " + " ".join(f"WHEN {fit} THEN '{name}'" for name, fit in fits.items()) + " END"
    label = "CASE rule " + " ".join(f"WHEN '{d}{p}' THEN '{verdict}'" for d, p, verdict in url_rules) + " END"

    def smoothed(blocked: str, labelled: str, above: str) -> str:
        return f"((CAST({blocked} AS DOUBLE) + {pathtree.PRIOR}::DOUBLE * {above}) / (CAST({labelled} AS DOUBLE) + {pathtree.PRIOR}::DOUBLE))"

    a, m, b, n = "CAST(m.b AS DOUBLE)", "CAST(o.l AS DOUBLE)", "CAST(o.b AS DOUBLE)", "CAST(m.l AS DOUBLE)"
    apart, spread = f"({a} * {m} - {b} * {n})", f"(({a} + {b}) * ({n} + {m} - ({a} + {b})))"
    alike = f"CASE WHEN m.l = 0 OR o.l = 0 THEN m.l = o.l ELSE {apart} * {apart} * ({n} + {m}) <= {pathtree.DIFFERENT!r}::DOUBLE * ({n} * {m}) * {spread} END"
    levels, ended = [], ["SELECT host, shape, q FROM s0 WHERE len(segs) = 0"]
    for d in range(1, pathtree.LEVELS + 1):
        last = d == pathtree.LEVELS
        levels.append(f"""
h{d} AS MATERIALIZED (SELECT *, {f"'{pathtree.REST}'" if last else f"segs[{d}]"} AS seg FROM s{d - 1} WHERE len(segs) >= {d}),
k{d} AS MATERIALIZED (SELECT host, node, seg, CAST(sum(n) AS BIGINT) AS n, CAST(sum(l) AS BIGINT) AS l, CAST(sum(b) AS BIGINT) AS b, max(q) AS q FROM h{d} GROUP BY 1, 2, 3),
c{d} AS MATERIALIZED (SELECT host, node, branch, CAST(sum(l) AS BIGINT) AS l, CAST(sum(b) AS BIGINT) AS b, max(q) AS q FROM
  (SELECT *, CASE WHEN n * {pathtree.LITERAL} >= sum(n) OVER (PARTITION BY host, node) THEN seg ELSE '{pathtree.WILD}' END AS branch FROM k{d}) GROUP BY 1, 2, 3),
o{d} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY host, node ORDER BY rate, branch) AS r FROM (SELECT *, CASE WHEN l > 0 THEN b / l ELSE -1 END AS rate FROM c{d})),
m{d} AS (SELECT host, node, branch, q, r, branch AS rep, l, b FROM o{d} WHERE r = 1
  UNION ALL SELECT host, node, branch, q, r, CASE WHEN alike THEN rep ELSE branch END, CASE WHEN alike THEN l0 + l ELSE l END, CASE WHEN alike THEN b0 + b ELSE b END
  FROM (SELECT o.host, o.node, o.branch, o.q, o.r, m.rep, o.l, o.b, m.l AS l0, m.b AS b0, {alike} AS alike FROM m{d} m JOIN o{d} o ON o.host = m.host AND o.node = m.node AND o.r = m.r + 1)),
g{d} AS MATERIALIZED (SELECT host, node, branch, rep, {smoothed("last_value(b) OVER w", "last_value(l) OVER w", "q")} AS q FROM m{d}
  WINDOW w AS (PARTITION BY host, node, rep ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s{d} AS MATERIALIZED (SELECT h.host, h.shape, h.segs, h.n, h.l, h.b, coalesce(x.q, y.q) AS q, h.node || '/' || coalesce(x.rep, y.rep) AS node FROM h{d} h
  LEFT JOIN g{d} x ON x.host = h.host AND x.node = h.node AND x.branch = h.seg
  LEFT JOIN g{d} y ON y.host = h.host AND y.node = h.node AND y.branch = '{pathtree.WILD}')""")
        ended.append(f"SELECT host, shape, q FROM s{d}" + ("" if last else f" WHERE len(segs) = {d}"))
    return f"""
WITH RECURSIVE parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS MATERIALIZED (SELECT *, {label} AS label, regexp_replace(replace(path, '*', '%2A'), '[0-9]+', '#', 'g') AS shape FROM (SELECT *, {rule} AS rule FROM named)),
shapes AS MATERIALIZED (SELECT host, shape, count(*) AS n, count(label) AS l, count(*) FILTER (label = 'block') AS b,
  CASE WHEN shape = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(substr(shape, 2), '/') END AS segs FROM ruled GROUP BY host, shape),
hosts AS MATERIALIZED (SELECT host, {smoothed("sum(b)", "sum(l)", "(SELECT (coalesce(sum(b), 0) + 1.0::DOUBLE) / (coalesce(sum(l), 0) + 2.0::DOUBLE) FROM shapes)")} AS q FROM shapes GROUP BY host),
s0 AS MATERIALIZED (SELECT shapes.*, q, '' AS node FROM shapes JOIN hosts USING (host)),{",".join(levels)},
ended AS MATERIALIZED ({" UNION ALL ".join(ended)})
SELECT page_id, r.host, path, rule, coalesce(label, CASE WHEN q > {pathtree.REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN ended e ON e.host = r.host AND e.shape = r.shape
"""


def repair_sql() -> str:
    """``op11_repair``: whole audits and texts of the four states, carried from row to row by a recursive query."""
    moves = []
    for initial in ("s", "u", "a", ""):
        for forced, cut in ((True, False), (False, False), (False, True)):
            cost = {(s, to): c for s, to, c, _ in conv.steps(initial, forced, cut)[0]}
            for (s, to), word in conv.steps(initial, forced, cut)[1].items():
                before, at = "", s
                for _ in range(word.count("I")):
                    before, at = before + ("assistant:" if at == conv.USER else "user:") + "\\n", conv.ASSISTANT if at == conv.USER else conv.USER
                role = {"D": "NULL", "K": "''", "R": "'assistant'" if at == conv.USER else "'user'"}[word[-1]]
                moves.append(f"('{initial}', {forced}, {cut}, {s}, {to}, {cost[s, to]}, '{word}', E'{before}', {role})")
    closing = "(0, 0, '', ''), (1, 4, 'II', E'user:\\nassistant:\\n'), (2, 2, 'I', E'assistant:\\n'), (3, 0, '', '')"
    return rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda ch: list_transform(range(8), lambda j: (ascii(ch) >> j) & 1)))),
  lambda c, bit: xor(c >> 1, 3988292384::BIGINT * (xor(c, bit) & 1))), 4294967295::BIGINT) % 20 AS fault FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN fault = 0 THEN 0 WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS r FROM damaged),
judged AS MATERIALIZED (SELECT *, NOT regexp_matches(text, '[^{_SPACE}]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again,
  NOT regexp_matches(text, '[.!?][{_SPACE}]*$') AS cut, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) AS following FROM ordered),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
  count(*) FILTER (following IS NOT NULL AND left(role, 1) || following NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
moves(initial, forced, cut, s, nxt, c, word, before, own) AS MATERIALIZED (VALUES {", ".join(moves)}),
kinds AS MATERIALIZED (SELECT conv_id, r, role, text, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '' END AS initial,
  blank OR again AS forced, cut AND NOT (blank OR again) AS cut FROM judged),
walked AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS r, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM conversations
  UNION ALL SELECT conv_id, r, nxt, cost, audit, lines FROM (
    SELECT w.conv_id, k.r, m.nxt, w.cost + m.c AS cost, w.audit || m.word AS audit,
      w.lines || m.before || CASE WHEN m.own IS NULL THEN '' WHEN m.own = '' THEN k.role || ':' || k.text || chr(10) ELSE m.own || ':' || k.text || chr(10) END AS lines
    FROM walked w JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.r = w.r + 1
      JOIN moves m ON m.initial = k.initial AND m.forced = k.forced AND m.cut = k.cut AND m.s = w.s)
  QUALIFY row_number() OVER (PARTITION BY conv_id, nxt ORDER BY cost, audit) = 1),
sizes AS (SELECT conv_id, max(r) AS n FROM walked GROUP BY conv_id),
closed AS (SELECT w.conv_id, w.cost + e.c AS cost, w.audit || e.word AS audit, w.lines || e.after AS lines FROM walked w JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.r
  JOIN (VALUES {closing}) e(s, c, word, after) ON e.s = w.s QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + e.c, w.audit || e.word) = 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, audit, sha256(CASE WHEN lines = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
FROM closed d LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM d.conv_id
"""
