"""Scalar statistics that are NULL, not an error, when they are undefined."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def null_if_nan(value: Column) -> Column:
    return F.when(F.isnan(value), None).otherwise(value)


def coefficient_of_variation(std: Column, mean: Column) -> Column:
    return F.try_divide(std, mean)


def mean_of_exact(value: Column) -> Column:
    """Mean from an exact decimal sum, so the result does not depend on row order."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def pearson(x: Column, y: Column) -> tuple[Column, Column]:
    """(r, pairs) over rows where both sides are present; r is NULL without variance.

    ``corr`` raises on a constant column under ANSI mode, so r comes from its parts.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    pairs = F.count(a)
    varies = (pairs >= 2) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    r = F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    return r, pairs


def confusion_ratios(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1, false-positive rate and accuracy; NULL on 0/0."""
    precision = F.try_divide(tp.cast("double"), tp + fp)
    recall = F.try_divide(tp.cast("double"), tp + fn)
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(
        F.try_divide(2 * precision * recall, precision + recall)
    )
    return {
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "false_positive_rate": F.try_divide(fp.cast("double"), fp + tn),
        "accuracy": F.try_divide((tp + tn).cast("double"), tp + fp + fn + tn),
    }


def bins(value: Column, low: Column, high: Column, count: int) -> Column:
    """Equal-width bin 1..count; the top edge belongs to the last bin.

    A constant column has no width, so its rows all land in bin 1.
    """
    width = (high - low) / F.lit(count)
    return F.when(value.isNull(), None).otherwise(
        F.least(F.coalesce(F.floor(F.try_divide(value - low, width)).cast("int") + 1, F.lit(1)), F.lit(count))
    )
