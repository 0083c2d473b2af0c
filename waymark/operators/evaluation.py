"""How runs are summed up: means by axis, how far two judgements of one thing differ, medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def axis_means(scores: DataFrame, axes: list[str]) -> DataFrame:
    """One row: the mean of each axis and of their sum."""
    total = sum((F.col(a) for a in axes), F.lit(0))
    return scores.agg(*[F.avg(a).alias(a) for a in axes], F.avg(total).alias("total"))


def judge_noise(first: list[str], second: list[str]) -> Column:
    """Mean over rows of how much two judgements of the same thing differ, summed over the axes."""
    return F.avg(sum((F.abs(F.col(a) - F.col(b)) for a, b in zip(first, second, strict=True)), F.lit(0)))


def upper_median(x: Column | str) -> Column:
    """The middle value, of two middle ones the upper; for groups of a few runs each."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))
