"""Vocabulary lookup, subtokens and the labels they inherit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_layout

UNKNOWN = "'[UNK]_'"


def vocabulary(lines: DataFrame, order: str = "line_no", token: str = "token") -> DataFrame:
    """(token, id) of a vocabulary file's lines, without white space at the ends; of equal tokens the last counts."""
    return lines.select(F.regexp_replace(token, r"^\s+|\s+$", "").alias("token"), F.col(order).alias("id")).groupBy("token").agg(F.max("id").alias("id"))


def most_frequent(tokens: DataFrame, size: int, token: str = "token") -> DataFrame:
    """(token, id) of the ``size`` most frequent tokens, id 0 the most frequent, ties by token."""
    top = tokens.groupBy(token).count().orderBy(F.col("count").desc(), token).limit(size)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col(token).alias("t")))).alias("a"))
    return ranked.select(F.posexplode("a").alias("id", "s")).select(F.col("s.t").alias("token"), F.col("id").cast("long").alias("id"))


def lookup(tokens: DataFrame, vocab: DataFrame, unknown: int, token: str = "token") -> DataFrame:
    """``tokens`` with ``id``, that of the unknown token where the vocabulary has none."""
    return tokens.join(vocab.select(F.col("token").alias(token), "id"), token, "left").withColumn("id", F.coalesce("id", F.lit(unknown).cast("long")))


def inherited(label: Column, place: Column) -> Column:
    """Label of a token's piece: the first keeps B and F, later ones are inside; I and O are copied."""
    return F.when((place > 0) & label.isin(0, 3), 1).otherwise(label)


def fixed_pieces(token: Column, size: int) -> Column:
    """Pieces of at most ``size`` characters, in order."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(token), F.lit(1)) - 1) / size).cast("int")), lambda i: F.substring(token, i * size + 1, F.lit(size)))


def subtoken_labels(tokens: Column, labels: Column, split) -> Column:
    """Array of struct<token, label> for all pieces of all tokens; ``split`` gives a token's pieces."""
    return F.flatten(F.transform(F.arrays_zip(tokens.alias("t"), labels.alias("l")), lambda x: F.transform(split(x["t"]), lambda p, i: F.struct(p.alias("token"), inherited(x["l"], i).cast("int").alias("label")))))


def without_layout(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``tokens`` (keys, ``pos``, ``token``, ``label``) without layout tokens.

    A B or F on a removed token waits, over a run of removed I's, for the next
    token kept: an I there takes it.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    gone = is_layout(F.col("token"))
    # what the row leaves waiting: nothing, or a removed token's letter; a removed I leaves things as they are
    leaves = F.when(~gone, F.struct(F.lit(None).cast("int").alias("letter"))).when(F.col("label") != 1, F.struct(F.when(F.col("label").isin(0, 3), F.col("label").cast("int")).alias("letter")))
    waiting = F.last(leaves, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))["letter"]
    taken = F.when((F.col("label") == 1) & waiting.isNotNull(), waiting).otherwise(F.col("label").cast("int"))
    return tokens.withColumns({"__gone": gone, "__label": taken}).filter(~F.col("__gone")).drop("__gone").withColumn("label", F.col("__label")).drop("__label")


def subwords(vocab: frozenset[str]):
    """Pandas UDF: greedy longest-match pieces of a token with its end mark ``_``; single characters where nothing fits."""
    longest = max(map(len, vocab), default=1)

    @F.pandas_udf("array<string>")
    def split(tokens):
        def one(token):
            if token is None:
                return None
            text, at, out = token + "_", 0, []
            while at < len(text):
                for end in range(min(len(text), at + longest), at, -1):
                    if text[at:end] in vocab or end == at + 1:
                        out.append(text[at:end])
                        at = end
                        break
            return out

        return tokens.map(one)

    return split
