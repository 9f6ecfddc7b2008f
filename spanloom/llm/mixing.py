"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent between 0
(even) and 1 (as they are), normalised.  The target is an entropy: that of the
shares as they are, and a part (``evenness``) of what lacks to the largest
possible.  Bisection finds the largest exponent whose weights reach it; if a
source would then repeat more often than the limit allows, the exponent is the
smallest that keeps the limit.  The budget is the least number of tokens that
gives each source one whole pass at least, times ``scale``.

A source's budget is met by passes over its documents.  They lie in blocks of
about ``block_tokens``; each pass takes the blocks in an order of its own, and
the documents of a block in an order of their own, until the budget is
used up: a document is in if it begins before the budget's end.  ``at`` is the
place of a document in the mixture, from 0 to 1: sorted by it, every stretch
of the mixture holds the sources in their weights.

Orders come from hashes, so a task that is run again gives the same rows.  A
source is never gathered in one place: blocks are, and there are as many as its
tokens ask for, up to ``MOST_BLOCKS``.  Up to ``FEW_SOURCES`` are weighed on the
driver; of more, each step of the bisection sums them in Spark.

Cases: a null source is a source; a null or empty text has ``overhead`` tokens
alone; repeated rows are rows of their own; an empty table gives no row; of
sources without tokens each counts as one token; other columns stay as they
are, but for ``pass``, ``block``, ``at`` and ``weight``, which the result's own
replace.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Blocks of a source at most; sources weighed on the driver, and broadcast, at most; columns that the result adds.
MOST_BLOCKS, FEW_SOURCES, ADDED = 65_536, 100_000, ("pass", "block", "at", "weight")

#: Sums over all sources for an exponent x: of share ** x, and of share ** x * ln(share).
Moments = Callable[[float], tuple[float, float]]


def moments_of(tokens: Iterable[float]) -> Moments:
    tokens = list(tokens)
    total = math.fsum(tokens)
    logs = [math.log(t / total) for t in tokens]

    def at(x: float) -> tuple[float, float]:
        raised = [math.exp(x * s) for s in logs]
        return math.fsum(raised), math.fsum(r * s for r, s in zip(raised, logs, strict=True))

    return at


def weights_of(tokens: list[float], exponent: float) -> list[float]:
    """Normalised shares to the power of ``exponent``."""
    total = math.fsum(tokens)
    raised = [(t / total) ** exponent for t in tokens]
    whole = math.fsum(raised)
    return [r / whole for r in raised]


def entropy(moments: Moments, exponent: float) -> float:
    """Of the weights: -sum w ln w, with w = share ** x / sum."""
    whole, logs = moments(exponent)
    return math.log(whole) - exponent * logs / whole


def repetition(least: float, most: float, exponent: float, scale: float = 1.0) -> float:
    """Passes over the most repeated source, the smallest, if the least repeated, the largest, has ``scale``."""
    return scale * (most / least) ** (1 - exponent)


def bisect(holds: Callable[[float], bool], steps: int = 50) -> tuple[float, float]:
    """Where ``holds`` ends, going up from 0 to 1: the last place known to hold and the first known not to."""
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low, high


def exponent_for(moments: Moments, sources: int, least: float, most: float, evenness: float, most_passes: float, scale: float = 1.0) -> float:
    """The exponent.  Entropy and passes fall as it grows, so each limit is one bisection."""
    if sources < 2 or least == most or evenness <= 0:
        return 1.0
    own = entropy(moments, 1.0)
    target = own + min(1.0, evenness) * (math.log(sources) - own)
    even = bisect(lambda x: entropy(moments, x) >= target)[0]
    fits = lambda x: repetition(least, most, x, scale) <= most_passes * (1 + 1e-12)
    if fits(even):
        return even
    return bisect(lambda x: not fits(x))[1] if fits(1.0) else 1.0


def plan(docs: DataFrame, evenness: float, most_passes: float, scale: float = 1.0, source_col: str = "source", tokens_col: str = "n_tokens") -> tuple[DataFrame, bool, float]:
    """(src, tokens, budget in tokens, weight, blocks-free table) of the sources, whether they are few, and the exponent."""
    found = docs.groupBy(F.col(source_col).alias("src")).agg(F.greatest(F.sum(tokens_col), F.lit(1)).cast("long").alias("tokens"))
    found = materialize(found, "sources")
    n, total, least, most = found.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    few = n <= FEW_SOURCES
    if not n:
        return found.select("src", "tokens", F.lit(0).cast("long").alias("budget"), F.lit(0.0).alias("weight")), few, 1.0
    if few:
        moments = moments_of(sorted(r[0] for r in found.select("tokens").collect()))
    else:
        log = F.log(F.col("tokens") / F.lit(float(total)))
        moments = lambda x: tuple(found.agg(F.sum(F.exp(log * x)), F.sum(F.exp(log * x) * log)).first())
    x = exponent_for(moments, n, least, most, evenness, most_passes, scale)
    whole = moments(x)[0]
    weight = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(x)) / whole
    # the largest source is the one repeated least
    budget = scale * most / ((most / total) ** x / whole)
    least_budget = F.col("tokens") if scale >= 1 else F.lit(1)
    return found.select("src", "tokens", F.greatest(least_budget, F.round(weight * budget)).cast("long").alias("budget"), weight.alias("weight")), few, x


def count_tokens(text_col: str, overhead: int = 1):
    """Words of a text (runs of other than white space) and ``overhead`` for its end."""
    return (F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S+")) + overhead).cast("long")


def mix(docs: DataFrame, evenness: float = 0.5, most_passes: float = 2.0, scale: float = 1.0, block_tokens: int = 16_384, seed: int = 17, key_cols: tuple[str, ...] = ("doc_id",), source_col: str = "source", tokens_col: str = "n_tokens") -> DataFrame:
    """The rows of ``docs`` as the mixture takes them, once for each pass, with ``pass``, ``block``, ``at`` and ``weight``.

    ``docs`` needs ``tokens_col``, positive and without nulls, and is read three times: give a written table.
    """
    plans, few, _ = plan(docs, evenness, most_passes, scale, source_col, tokens_col)
    plans = plans.select("*", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("tokens") / block_tokens)).cast("int").alias("blocks"), (F.ceil(F.col("budget") / F.col("tokens")) - 1).cast("int").alias("last"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("own"), F.col(tokens_col).alias("n"), F.struct(*(F.col(c) for c in key_cols)).alias("key"))
    placed = rows.join(F.broadcast(plans) if few else plans, F.col("own").eqNullSafe(F.col("src"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("blocks")).cast("int"))
    # tokens of each block, before it in its pass: MOST_BLOCKS rows a source and pass
    blocks = placed.groupBy("src", "block", "last").agg(F.sum("n").alias("n")).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("last"))))
    order = Window.partitionBy("src", "pass").orderBy(F.xxhash64(F.lit(seed), "pass", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(F.col("src").alias("s"), F.col("block").alias("b"), F.col("pass").alias("p"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("last"))))
    joined = passes.join(before, F.expr("src <=> s AND block = b AND pass = p"))
    inside = Window.partitionBy("src", "block", "pass").orderBy(F.xxhash64(F.lit(seed), "pass", "key"), "key").rowsBetween(Window.unboundedPreceding, -1)
    begun = joined.withColumn("begin", F.col("pass") * F.col("tokens") + F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED]
    return begun.filter("begin < budget").select(*kept, "pass", "block", (F.col("begin") / F.col("budget")).alias("at"), "weight")
