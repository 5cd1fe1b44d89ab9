"""Exact medians that never hold a whole group in one task.

``percentile`` keeps one map of all distinct values per group. Here a mergeable sketch
brackets the median per group, then only the values inside the bracket are counted:
at most about 0.3 % of a group, and at most one row per distinct reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_ACCURACY = 10_000
_MARGIN = 0.001  # ten times the sketch's rank error
_ORDERED = 100_000  # values of a bracket that one task puts in order


def bracket(value: Column) -> Column:
    """Aggregate expression [low, high] that is sure to enclose the median."""
    ends = F.array(F.lit(0.5 - _MARGIN), F.lit(0.5 + _MARGIN))
    return F.percentile_approx(value.cast("double"), ends, _ACCURACY)


def exact_percentiles(rows: DataFrame, value: str, percents: list[float]) -> list[float]:
    """Exact percentiles (linear interpolation) of one column over the whole table; an empty one has none."""
    found = exact_percentiles_of(rows, [(F.col(value), p) for p in percents])
    return [x for x in found if x is not None]


def exact_percentiles_of(rows: DataFrame, wanted: list[tuple[Column, float]]) -> list[float | None]:
    """Exact percentiles of several columns at once; None for a column without values.

    Each percentile has a bracket of values, at first all of them. Passes over the table narrow all brackets with
    sketches of what lies inside and count what lies below, until few values are left; only those are put in
    order. The passes change the cost alone: any bracket that holds the two ranks gives the same values.
    """
    names = [f"_x{i}" for i in range(len(wanted))]
    present = rows.select(*[c.cast("double").alias(n) for n, (c, _) in zip(names, wanted)])
    ends = present.agg(*[f(n) for n in names for f in (F.count, F.min, F.max)]).first() if wanted else []
    totals = [ends[3 * i] for i in range(len(wanted))]
    spots = [p / 100 * (n - 1) for n, (_, p) in zip(totals, wanted)]
    brackets = [(ends[3 * i + 1], ends[3 * i + 2], 0, n) for i, n in enumerate(totals)]  # low, high, values below, values inside
    open_ones = [i for i, n in enumerate(totals) if n]
    while open_ones := [i for i in open_ones if brackets[i][3] > _ORDERED and brackets[i][0] < brackets[i][1]]:
        sketches = []
        for i in open_ones:
            low, high, below, inside = brackets[i]
            at, x = (spots[i] - below) / inside, F.col(names[i])
            shares = F.array(*[F.lit(min(1.0, max(0.0, at + side * _MARGIN))) for side in (-1, 1)])
            sketches.append(F.percentile_approx(F.when(x.between(low, high), x), shares, F.lit(_ACCURACY)))
        found = present.agg(*sketches).first()
        counts = present.agg(*[c for i, (lo, hi) in zip(open_ones, found) for c in (F.count_if(F.col(names[i]) < lo), F.count_if(F.col(names[i]).between(lo, hi)))]).first()
        narrowed = []
        for n, i in enumerate(open_ones):
            below, inside = counts[2 * n], counts[2 * n + 1]
            held = below <= int(spots[i]) and min(int(spots[i]) + 1, totals[i] - 1) < below + inside
            if held and inside < brackets[i][3]:
                brackets[i] = (*found[n], below, inside)
                narrowed.append(i)
        open_ones = narrowed
    some = [i for i, n in enumerate(totals) if n]
    if not some:
        return [None] * len(wanted)
    hits = [F.when(F.col(names[i]).between(*brackets[i][:2]), F.struct(F.lit(i).alias("i"), F.col(names[i]).alias("x"))) for i in some]
    counted = present.select(F.explode(F.array_compact(F.array(*hits))).alias("_h")).groupBy(F.col("_h.i").alias("_i"), F.col("_h.x").alias("_x")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_i").orderBy("_x"))
    ranked = counted.withColumn("_upto", upto + F.get(F.array(*[F.lit(b[2]) for b in brackets]), F.col("_i")))

    def at_rank(ranks: list[int]) -> Column:
        rank = F.get(F.array(*[F.lit(k + 1) for k in ranks]), F.col("_i"))
        return F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), F.col("_x")))

    result = ranked.groupBy("_i").agg(
        at_rank([max(0, int(s)) for s in spots]).alias("lo"), at_rank([max(0, min(int(s) + 1, n - 1)) for s, n in zip(spots, totals)]).alias("hi")
    ).collect()
    by_index = {f["_i"]: (f["lo"], f["hi"]) for f in result}
    return [by_index[i][0] + (by_index[i][1] - by_index[i][0]) * (s - int(s)) if i in by_index else None for i, s in enumerate(spots)]


def exact_medians(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of several columns in the same passes."""
    return dict(zip(columns, exact_percentiles_of(rows, [(F.col(c), 50) for c in columns])))


def array_median(values: Column) -> Column:
    """Median of a small array without NULLs; NULL for an empty one."""
    ordered, size = F.sort_array(values), F.size(values)
    middle = F.floor(size / 2).cast("int")
    upper = F.get(ordered, middle)
    return F.when(size % 2 == 1, upper).otherwise((F.get(ordered, middle - 1) + upper) / 2)


def with_exact_median(rows: DataFrame, stats: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Replace ``_bracket`` in ``stats`` (one row per key, with ``_n``) by the exact median.

    ``rows`` is the input of ``stats``; keys are never NULL. No side is hinted: Spark broadcasts the brackets
    when their measured size allows and otherwise splits skewed keys of the sort join.
    """
    ends = stats.select(*keys, F.col("_n").alias("_total"), F.col("_bracket")[0].alias("_lo"), F.col("_bracket")[1].alias("_hi"))
    x = F.col(value).cast("double")
    counted = (
        rows.select(*keys, x.alias("_x"))
        .where(F.col("_x").isNotNull())
        .join(ends, keys)
        .where(F.col("_x") <= F.col("_hi"))
        .groupBy(*keys, F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_v"))
        .agg(F.count("*").alias("_c"), F.first("_total").alias("_total"))
    )
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    ranked = counted.withColumn("_upto", upto)

    def at(rank: Column) -> Column:
        inside = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank)
        return F.max(F.when(inside, F.col("_v")))

    half = F.floor(F.col("_total") / 2)
    median = ranked.groupBy(*keys).agg(
        ((at(F.floor((F.col("_total") + 1) / 2)) + at(half + 1)) / 2).alias("_median")
    )
    missed = F.raise_error(F.lit("median outside its bracket"))
    return stats.join(median, keys, "left").select(
        *[c for c in stats.columns if c not in ("_bracket", "_n")],
        F.when(F.col("_n") == 0, None).otherwise(F.coalesce("_median", missed.cast("double"))).alias(out),
    )
