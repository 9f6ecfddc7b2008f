"""Model examples from blocks: arrays of ids, labels, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.ids import separator_id

CLS, SEP = "[CLS]_", "[SEP]_"


def assembled(query: Column, program: Column, labels: Column) -> Column:
    """struct<tokens, labels, segments, mask> of ``[CLS] query [SEP] program``; the prefix has label 4 and segment 0."""
    head = F.concat(F.array(F.lit(CLS)), query, F.array(F.lit(SEP)))
    n = F.size(head)
    return F.struct(
        F.concat(head, program).alias("tokens"),
        F.concat(F.transform(head, lambda _: F.lit(arrays.PAD)), labels).alias("labels"),
        F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), F.size(program))).alias("segments"),
        F.array_repeat(F.lit(1), n + F.size(program)).alias("mask"),
    )


def fitted(example: Column, size: int, pad_token: str = "[PAD]_") -> Column:
    """An example cut or filled to the size of the model's input."""
    return F.struct(*(arrays.fitted(example[n], size, F.lit(fill)).alias(n) for n, fill in (("tokens", pad_token), ("labels", arrays.PAD), ("segments", 0), ("mask", 0))))


def span_examples(blocks: DataFrame, keys: Sequence[str], query: str) -> DataFrame:
    """One example for each key from its relevant blocks in order of ``block_pos``, with a separator between blocks.

    ``blocks``: keys, query tokens, block_pos, block_id, tokens, labels, relevant.  Keys without a relevant block give no example.
    """
    rows = blocks.filter("relevant").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_pos", "block_id", "tokens", "labels"))).alias("b"), F.first(query).alias("__q"))
    part = lambda f, sep: arrays.joined(F.transform("b", f), sep)
    made = assembled(F.col("__q"), part(lambda b: b["tokens"], F.lit(SEP)), part(lambda b: b["labels"].cast("array<int>"), F.lit(arrays.PAD)))
    return rows.select(*keys, made.alias("example"), part(lambda b: F.transform(b["tokens"], lambda _: b["block_id"]), separator_id()).alias("block_ids"))


def relevance_examples(blocks: DataFrame, keys: Sequence[str], query: str, with_single_hop: bool = True, distributable: str = "distributable") -> DataFrame:
    """One example for each block with its relevance; blocks of distributable queries only on demand."""
    kept = blocks if with_single_hop else blocks.filter(~F.col(distributable))
    return kept.select(*keys, "block_pos", assembled(F.col(query), F.col("tokens"), F.transform("tokens", lambda _: F.lit(arrays.PAD))).alias("example"), F.col("relevant").cast("int").alias("relevance_label"))


def groupwise_examples(blocks: DataFrame, keys: Sequence[str], query: str) -> DataFrame:
    """All blocks of a key as a list of examples, in order of ``block_pos``."""
    one = F.struct("block_pos", assembled(F.col(query), F.col("tokens"), F.col("labels").cast("array<int>")).alias("example"), F.col("relevant").cast("int").alias("relevance_label"))
    return blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("items"))


def two_step(blocks: DataFrame, keys: Sequence[str], predicted: str = "predicted", relevant: str = "relevant") -> DataFrame:
    """For each key the relevant blocks of prediction and target.

    ``blocks``: keys, block_pos, tokens, labels and two booleans.  A key with
    one block takes it on both sides, whatever was predicted.  Result:
    ``predicted_blocks`` and ``target_blocks``, arrays of struct<block_pos,
    tokens, labels>.
    """
    rows = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_pos", "tokens", "labels", F.col(predicted).alias("p"), F.col(relevant).alias("r")))).alias("b"))
    pick = lambda c: F.transform(F.filter("b", lambda x: x[c] | (F.size("b") == 1)), lambda x: F.struct(x["block_pos"].alias("block_pos"), x["tokens"].alias("tokens"), x["labels"].alias("labels")))
    return rows.select(*keys, pick("p").alias("predicted_blocks"), pick("r").alias("target_blocks"))


def block_spans(blocks: Column, most: int | None = None) -> Column:
    """Array of struct<tag, block, first, last>: spans of each block, so their order doesn't matter."""
    each = F.transform(blocks, lambda b: F.transform(arrays.spans(b["labels"]), lambda s: F.struct(s["tag"].alias("tag"), b["block_pos"].alias("block"), s["first"].alias("first"), s["last"].alias("last"))))
    found = F.flatten(each)
    return found if most is None else F.filter(found, lambda s: s["last"] < most)
