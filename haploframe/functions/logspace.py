"""Sums of logarithms as column expressions and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logsumexp(*values: Column) -> Column:
    """ln of the sum of exponentials of two or more columns."""
    top = F.greatest(*values)
    return top + F.log(reduce(lambda a, b: a + b, (F.exp(v - top) for v in values)))


def log10_add(a: Column, b: Column, floor: float = -998.0) -> Column:
    """log10 of the sum of two powers of ten; a value at or below the floor counts as zero."""
    top, low = F.greatest(a, b), F.least(a, b)
    return F.when(a <= floor, b).when(b <= floor, a).otherwise(top + F.log10(1 + F.pow(F.lit(10.0), low - top)))


#: Values of one bucket are at most so far apart that their exponentials can be summed.
SPAN = 256.0


def logsumexp_by(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """ln of the sum of exponentials for each key.

    Sums are taken over buckets of values, partly before the shuffle, as exponentials over the bucket's greatest value; a
    key's few buckets, (top, sum) states, are then merged. The rows are read once and joined with nothing.
    """
    top = F.ceil(F.col(x) / SPAN) * SPAN
    states = df.select(*keys, F.col(x).cast("double").alias("_x"), top.alias("_top")).groupBy(*keys, "_top").agg(F.sum(F.exp(F.col("_x") - F.col("_top"))).alias("_sum"), F.max("_x").alias("_max"))
    # A bucket whose sum is 0 in doubles holds nothing beside its greatest value.
    whole = F.when(F.col("_sum") > 0, F.col("_top") + F.log("_sum")).otherwise(F.col("_max"))
    both = lambda a, v: F.greatest(a, v) + F.log1p(F.exp(F.least(a, v) - F.greatest(a, v)))
    merged = F.aggregate("_all", F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise(both(a, v)))
    return states.groupBy(*keys).agg(F.collect_list(whole).alias("_all")).select(*keys, merged.alias(name))
