"""Hooks for models: batches of examples, scorers, and services that answer prompts."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a service gives for each prompt: its text, why it ended, and whether it is one.
RESPONSE = "response struct<text:string,finish_reason:string,success:boolean>"


def even(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, which fails when it runs if the arrays of a row differ in length."""
    first = F.size(columns[0])
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.size(c) == first)
    checked = F.when(F.coalesce(same, F.lit(False)), F.col(columns[0])).otherwise(F.raise_error(F.lit(f"arrays of different lengths: {', '.join(columns)}")).cast(df.schema[columns[0]].dataType))
    return df.withColumn(columns[0], checked)


def _in_batches(batches, size: int):
    for pdf in batches:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]


def scored(df: DataFrame, score: Callable[[pd.DataFrame], Sequence], kind: str, name: str = "score", batch: int = 16) -> DataFrame:
    """``df`` with ``name``, what ``score`` gives for each row of a batch of at most ``batch`` rows: a list as long as the batch."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for pdf in _in_batches(batches, batch):
            found = list(score(pdf))
            if len(found) != len(pdf):
                raise ValueError(f"{len(found)} scores for {len(pdf)} rows")
            yield pdf.assign(**{name: found})

    return df.mapInPandas(run, f"{kinds}, `{name}` {kind}")


def answered(prompts: DataFrame, ask: Callable[[list[str]], Sequence[tuple[str, str]]], prompt: str = "prompt", batch: int = 4, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """``prompts`` with ``response``: what ``ask`` gives for a batch, (text, finish_reason) each.

    A batch that fails is asked again after a wait that doubles, up to
    ``attempts`` times; then its rows have no text, the error as the reason, and no success.
    A task that is run again asks again.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def run(batches):
        for pdf in _in_batches(batches, batch):
            for attempt in range(attempts):
                try:
                    found = [{"text": t, "finish_reason": why, "success": True} for t, why in ask(list(pdf[prompt]))]
                    break
                except Exception as e:  # a service fails in its own ways; the row says how
                    found = [{"text": None, "finish_reason": f"{type(e).__name__}: {e}", "success": False}] * len(pdf)
                    time.sleep(wait * 2**attempt if attempt + 1 < attempts else 0)
            yield pdf.assign(response=found)

    return prompts.mapInPandas(run, f"{kinds}, {RESPONSE}")


def bpe_count(path: str, pattern: str) -> Callable[[Column], Column]:
    """A counter of tokens for a file of ranks (base64 of a token's bytes and its rank, by line) and the pattern that splits a text."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(path, pattern)
        return texts.map(lambda t: 0 if t is None else len(encoding.encode_ordinary(t)))

    return count


_KNOWN: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    """One for each worker process."""
    if (path, pattern) not in _KNOWN:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _KNOWN[path, pattern] = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _KNOWN[path, pattern]
