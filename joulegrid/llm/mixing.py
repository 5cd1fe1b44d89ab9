"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies of each document on average. Its whole part is
certain: every document is taken that often. The rest is a sample without replacement whose inclusion
probability is proportional to a document's size and certain (one) for the largest documents. Inside a
source, documents fall into strata of nearly equal size; each stratum gets a fixed number of documents, with
the rounding error in words carried from large strata to small ones, so the words taken meet the target to
within about one small document. In a stratum the documents with the smallest Pareto rank
``[u / (1 - u)] / [p / (1 - p)]`` are taken, u being a repeatable number of the document.

Everything that decides is in small tables, one row per source or per source and stratum; the documents
only meet the cut-off rank of their stratum.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F

from joulegrid.llm.common import WORD, stored, uniform

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = 42
STRATA_PER_OCTAVE = 8


def word_sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): one row per source, the words to take from it.

    ``sizes`` has one row per source. Weights repeat over the sources by code point, NULL last. The total is
    ``share`` of all words; a source stops at ``cap`` times its size and its excess goes to the others by
    weight until none is above, which is the level where the sources sorted by size over weight first fit.
    Windows without a key see one row per source, the length of the list of weights.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("w")).withColumn("limit", F.col("source_size") * cap)
    rising = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    rows = rows.select(
        "*",
        (F.sum("source_size").over(whole) * share).alias("total"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("filled"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("open_w"),
    ).withColumn("level", (F.col("total") - F.col("filled")) / F.col("open_w"))
    # sources up to the first that fits are full; that one's level holds for the rest
    fits = F.col("level") * F.col("w") < F.col("limit")
    level = F.min(F.when(fits, F.struct(F.col("limit") / F.col("w"), F.col("level").alias("level")))).over(whole)
    return rows.select("source", "source_size", F.least("limit", F.coalesce(F.col("w") * level["level"], "limit")).alias("target"))


def _stratum(size: Column) -> Column:
    return F.floor(F.log2(size) * STRATA_PER_OCTAVE).cast("int")


def _uniform(seed: int) -> Column:
    return uniform(seed, F.col("doc_id"))


def _rank(u: Column, p: Column) -> Column:
    """Pareto's odds ratio mapped to (0, 1), increasing in it."""
    q = (u / (1 - u)) * ((1 - p) / p)
    return q / (1 + q)


def strata(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """(source, stratum, source_size, target, whole, scale, n, take): the plan of the sample.

    ``whole`` copies are certain, ``take`` of the stratum's ``n`` documents get one more, and ``scale`` times
    the size is the inclusion probability, cut at one.
    """
    groups = rows.where("size > 0").groupBy("source", _stratum(F.col("size")).alias("stratum")).agg(
        F.count("*").alias("n"), F.sum("size").alias("words"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"), F.max("size").alias("most")
    )
    named = per_source.withColumnRenamed("source", "_source")
    joined = groups.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.col("target") / F.col("source_size")
    joined = joined.withColumn("whole", F.floor(ratio + 1e-9)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    falling = Window.partitionBy("source").orderBy(F.col("stratum").desc())
    above = falling.rowsBetween(Window.unboundedPreceding, -1)
    below = falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # with the strata above certain, this scale meets the rest; the first that stays within one holds
    scale = (F.col("rest") - F.coalesce(F.sum("words").over(above), F.lit(0))) / F.sum("squares").over(below)
    joined = joined.withColumn("_scale", scale)
    fits = (F.col("_scale") >= 0) & (F.col("_scale") * F.col("most") <= 1)
    each = Window.partitionBy("source")
    fitting = F.max(F.when(fits, F.struct("stratum", "_scale"))).over(each)
    # a rest of nearly all words in nearly equal sizes fits none: the lowest stratum it reaches, whose largest documents go beyond one
    first = F.coalesce(fitting, F.min(F.when(F.col("_scale") >= 0, F.struct("stratum", "_scale"))).over(each))
    mean = F.when(fitting.isNotNull(), F.col("words") / F.col("n")).otherwise(F.col("squares") / F.col("words"))
    joined = joined.withColumns({"scale": F.coalesce(first["_scale"], F.lit(0.0)), "_first": first["stratum"], "_mean": mean})
    joined = joined.withColumn("p", F.when(F.col("stratum") > F.col("_first"), 1.0).otherwise(F.least(F.lit(1.0), F.col("scale") * F.col("_mean"))))
    # at most a few hundred strata per source, from large to small, with the error carried along
    listed = joined.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("stratum")).alias("k"), "n", "words", "p")), True).alias("s"))

    def step(state: Column, s: Column) -> Column:
        owed = state["owed"] + s["p"] * s["words"]
        mean = s["words"] / s["n"]
        take = F.greatest(F.lit(0.0), F.least(s["n"].cast("double"), F.round(owed / mean)))
        return F.struct((owed - take * mean).alias("owed"), F.concat(state["t"], F.array(F.struct((-s["k"]).alias("stratum"), take.cast("long").alias("take")))).alias("t"))

    start = F.struct(F.lit(0.0).alias("owed"), F.expr("cast(array() as array<struct<stratum:int,take:bigint>>)").alias("t"))
    takes = listed.select("source", F.explode(F.aggregate("s", start, step)["t"]).alias("t")).select(F.col("source").alias("_source"), "t.stratum", "t.take")
    out = joined.join(takes.withColumnRenamed("stratum", "_stratum"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("stratum") == F.col("_stratum")))
    return out.select("source", "stratum", "source_size", "target", "whole", "scale", "n", "take")


def cutoffs(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``plan`` with the last rank and doc_id taken in each stratum (``cut_rank``, ``cut_id``).

    Ranks are counted in buckets first, as many as the root of the stratum's size, and only the bucket in
    which the cut falls is ordered: about as many rows as there are buckets.
    """
    partial = plan.where("take > 0 AND take < n").withColumnsRenamed({"source": "_source", "stratum": "_stratum"})
    met = rows.where("size > 0").select("source", "doc_id", "size", _stratum(F.col("size")).alias("stratum")).join(
        partial, F.col("source").eqNullSafe(F.col("_source")) & (F.col("stratum") == F.col("_stratum"))
    )
    ranked = met.select("source", "stratum", "doc_id", "take", "n", _ranks(seed).alias("rank"))
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") * F.ceil(F.sqrt("n"))))
    counts = ranked.groupBy("source", "stratum", "bucket", "take").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("source", "stratum").orderBy("bucket"))
    border = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("take")) & (F.col("_upto") - F.col("c") < F.col("take")))
    border = border.select(F.col("source").alias("_source"), F.col("stratum").alias("_stratum"), F.col("bucket").alias("_bucket"), (F.col("take") - F.col("_upto") + F.col("c")).alias("left"))
    inside = ranked.join(border, F.col("source").eqNullSafe(F.col("_source")) & (F.col("stratum") == F.col("_stratum")) & (F.col("bucket") == F.col("_bucket")))
    nth = F.row_number().over(Window.partitionBy("source", "stratum", "bucket").orderBy("rank", F.col("doc_id").asc_nulls_first()))
    cut = inside.withColumn("_nth", nth).where("_nth = left").select(
        F.col("source").alias("_source"), F.col("stratum").alias("_stratum"), F.col("rank").alias("cut_rank"), F.col("doc_id").alias("cut_id")
    )
    return plan.join(cut, F.col("source").eqNullSafe(F.col("_source")) & (F.col("stratum") == F.col("_stratum")), "left").drop("_source", "_stratum")


def _ranks(seed: int) -> Column:
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("scale") * F.col("size")))
    return _rank(_uniform(seed), p)


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_sizes(F.col("text").cast("string")).alias("size"))


def sample_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Targets per source, and cut-offs per source and stratum, for ``rows`` of (doc_id, source, size)."""
    per_source = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share))
    return per_source, stored(cutoffs(rows, stored(strata(rows, per_source)), seed))


def with_copies(rows: DataFrame, plans: tuple[DataFrame, DataFrame], seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, source, size and more) with source_size, target and copies.

    Both plan tables hold a row per source or stratum; Spark broadcasts them when their measured size allows.
    """
    per_source, cuts = plans
    named = per_source.withColumnRenamed("source", "_source")
    out = rows.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    cut = cuts.select(F.col("source").alias("_source"), F.col("stratum").alias("_stratum"), "whole", "scale", "n", "take", "cut_rank", "cut_id")
    out = out.join(cut, F.col("source").eqNullSafe(F.col("_source")) & (_stratum(F.col("size")) == F.col("_stratum")), "left")
    before = (_ranks(seed) < F.col("cut_rank")) | ((_ranks(seed) == F.col("cut_rank")) & (F.coalesce("doc_id", F.lit(-(1 << 63))) <= F.coalesce("cut_id", F.lit(-(1 << 63)))))
    more = F.when(F.col("take") >= F.col("n"), True).when(F.col("take") == 0, False).otherwise(before)
    copies = F.coalesce(F.col("whole") + more.cast("long"), F.lit(0)).cast("long")
    return out.withColumn("copies", copies).drop("_source", "_stratum", "whole", "scale", "n", "take", "cut_rank", "cut_id")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row.

    A NULL text has size zero and is never taken; a NULL source is a source of its own, last in order; a
    source without words has target zero. Rows that repeat a doc_id are taken or left together. Extra
    columns are ignored and an empty table gives no rows. The same seed gives the same mix.
    """
    rows = stored(sizes(docs))
    out = with_copies(rows, sample_plan(rows, weights, share, seed), seed)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The documents of the mix with ``copies`` and ``taken`` (words, repeats counted); those not taken go."""
    rows = stored(sizes(docs))
    plans = sample_plan(rows, weights, share, seed)
    base = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", F.col("source").cast("string").alias("source"), word_sizes(F.col("text")).alias("size"))
    out = with_copies(base, plans, seed).where("copies > 0")
    extra = [c for c in ("copies", "taken") if c not in docs.columns]
    return out.withColumn("taken", F.col("copies") * F.col("size")).select("_row.*", *extra)
