"""Hooks for models, smoothings of BLEU, words of spans."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.operators import metrics, scoring


def precisions(h, t, length, method):
    """Smoothed precisions of orders 1 to 4, from hits and totals of orders 1 to 5."""
    p = [a / b for a, b in zip(h, t, strict=True)]
    least = metrics.LEAST

    def mean(p):
        out, last = [], p[0] + 1
        for i in range(4):
            last = (last + p[i] + p[i + 1]) / 3
            out.append(last)
        return out

    if method == 2:
        return [p[0], *((h[i] + 1) / (t[i] + 1) for i in (1, 2, 3))]
    if method == 5:
        return mean(p)
    if method == 6:
        out = p[:2]
        for i in (2, 3):
            out.append((h[i] + 5 * (0 if out[i - 2] == 0 else out[i - 1] ** 2 / out[i - 2])) / (t[i] + 5))
        return [x or least for x in out]
    out, k = [], 1
    for i in range(4):
        x = p[i]
        if h[i] == 0:
            x = {0: least, 1: 0.1 / t[i], 3: 1 / (2**k * t[i])}.get(method, math.log(length) / (2**k * 5) / t[i] if length > 1 else least)
            k += 1
        out.append(x)
    return mean([*out, p[4]]) if method == 7 else out


@pytest.mark.parametrize("method", range(8))
def test_smoothings(spark, method):
    rng = random.Random(method)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randrange(0, 9))], [rng.choice("abc") for _ in range(rng.randrange(0, 9))]) for i in range(40)]
    got = {r["i"]: r["bleu"] for r in metrics.bleu(spark.createDataFrame(rows, "i int, r array<string>, c array<string>"), ["i"], F.col("r"), F.col("c"), method).collect()}
    for i, r, c in rows:
        grams = lambda x, n: Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1))
        h = [sum((grams(c, n) & grams(r, n)).values()) for n in range(1, 6)]
        t = [max(len(c) - n + 1, 1) for n in range(1, 6)]
        want = 0.0
        if c and h[0]:
            want = math.exp((0 if len(c) >= len(r) else 1 - len(r) / len(c)) + sum(math.log(x) for x in precisions(h, t, len(c), method)) / 4)
        assert abs(got[i] - want) < 1e-9 * max(1, want)


def test_span_words(spark):
    df = spark.createDataFrame([([(1, ["a", "b"]), (0, ["x", "y", "z"])], [(0, 1, 0, 0), (3, 0, 1, 2), (0, 0, 0, 0), (0, 9, 0, 0)])], "blocks array<struct<block_pos:int,tokens:array<string>>>, spans array<struct<tag:int,block:int,first:int,last:int>>")
    assert df.select(metrics.span_words(F.col("blocks"), F.col("spans"))).first()[0] == ["ans0", "x", "sf0", "y", "z", "ans1", "a"]


def test_scorers_get_batches(spark):
    df = spark.createDataFrame([(i, [i] * (i % 3)) for i in range(50)], "i int, x array<int>").repartition(2)
    got = scoring.scored(df, lambda pdf: [len(pdf)] * len(pdf), "int", batch=4)
    assert got.count() == 50 and max(r["score"] for r in got.collect()) == 4 and got.columns == ["i", "x", "score"]
    with pytest.raises(Exception, match="scores for"):
        scoring.scored(df, lambda pdf: [], "int").collect()
    assert scoring.scored(df.filter("false"), lambda pdf: [], "int").count() == 0


def test_arrays_of_a_batch_are_even(spark):
    df = spark.createDataFrame([([1, 2], [3, 4])], "a array<int>, b array<int>")
    assert scoring.even(df, ["a", "b"]).count() == 1
    with pytest.raises(Exception, match="different lengths"):
        scoring.even(df.union(df.select("a", F.array(F.lit(1)))), ["a", "b"]).collect()


def test_services_fail_by_row(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "i int, prompt string").coalesce(1)

    def ask(prompts):
        if "p3" in prompts:
            raise OSError("down")
        return [(p.upper(), "stop") for p in prompts]

    got = {r["i"]: r["response"] for r in scoring.answered(df, ask, batch=2, attempts=2, wait=0.01).collect()}
    assert got[0] == ("P0", "stop", True) and got[4].success
    assert got[3] == (None, "OSError: down", False) and got[2].success is False


def test_token_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    count = scoring.bpe_count(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("x" * 1000,)], "t string")
    got = [r[0] for r in df.select(count("t")).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 10
