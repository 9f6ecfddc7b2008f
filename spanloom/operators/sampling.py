"""Repeatable samples: rows are ranked by an MD5 of seed and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Hex digits of a rank by which rows are counted: 4096 classes.
EDGE = 3


def rank_key(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def stratified(df: DataFrame, strata: Sequence[str], keys: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` rows of each stratum.  Ranks are cut before a stratum's rows come together, so a large one isn't gathered."""
    order = Window.partitionBy(*strata).orderBy("__rank", *keys)
    return df.withColumn("__rank", rank_key(seed, *keys)).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= size).drop("__rank", "__n")


def smallest(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest ranks, ties by keys.

    Rows are counted by the first hex digits of the rank; whole classes of them
    go in by a filter, and only the class at the edge, one in ``16 ** EDGE``, is sorted.
    """
    head = F.substring(rank_key(seed, *keys), 1, EDGE)
    used = 0
    for digits, count in sorted(tuple(r) for r in df.groupBy(head).count().collect()):
        if used + count > n:
            edge = df.filter(head == digits).orderBy(rank_key(seed, *keys), *keys).limit(n - used)
            return df.filter(head < digits).unionByName(edge)
        used += count
    return df


def negatives(df: DataFrame, positive: Column, keys: Sequence[str], times: int = 3, seed: int = 42) -> DataFrame:
    """All positives and at most ``times`` as many negatives."""
    n = df.filter(positive).count()
    return df.filter(positive).unionByName(smallest(df.filter(~positive), times * n, keys, seed))


def refreshed(current: DataFrame, buffer: DataFrame, keys: Sequence[str], keep: float = 0.6, seed: int = 42) -> DataFrame:
    """The next epoch's negatives: a part of the current ones, the rest from the buffer, by the same ranks each epoch."""
    n = current.count()
    kept = int(keep * n)
    return smallest(current, kept, keys, seed).unionByName(smallest(buffer, n - kept, keys, seed))


def one_example(pool: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    return pool.orderBy(rank_key(seed, *keys), *keys).limit(1)


def selected(df: DataFrame, sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are in the sample."""
    return df.join(sample.select(*keys), list(keys), "left_semi")


def lacking(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def of_kind(df: DataFrame, kind: str) -> DataFrame:
    """Positive, negative or all examples; another kind gives none."""
    return df.filter({"positive": F.col("example_type") == 1, "negative": F.col("example_type") == 0, "all": F.lit(True)}.get(kind, F.lit(False)))
