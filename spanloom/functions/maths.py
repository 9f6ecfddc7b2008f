"""Arithmetic of the scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that k draws of n without replacement hold one of c."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, x: a * (1 - k / x.cast("double")))
    return F.when(n - c < k, 1.0).when(c <= 0, 0.0).otherwise(1 - product)


def choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k) if 0 <= k <= n else 0


def expected_best(scores: Column, n: int, k: int) -> Column:
    """Mean over all k-subsets of n scores of their largest; missing scores count as 0, more than n fail the query."""
    checked = F.when(F.size(scores) <= n, scores).otherwise(F.raise_error(F.lit(f"more than {n} scores")).cast("array<double>"))
    padded = F.array_sort(F.concat(checked, F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(scores), F.lit(0)))))
    weights = F.array(*(F.lit(choose(i, k - 1) / choose(n, k)) for i in range(n)))
    return F.aggregate(F.zip_with(padded, weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax of the target's logit."""
    top = F.array_max(logits)
    return F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top - F.get(logits, target)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
