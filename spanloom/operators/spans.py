"""Spans in text: overlap, containment, labelling, lookup of blocks.

Spans are 0-based with an exclusive end column: ``sl, sc, el, ec``.  Interval
joins meet on (key, line): a span is exploded over its lines, so the join is
an equi-join and its cost follows the lines, not the square of the spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays


def _one_way(a: Column, b: Column) -> Column:
    lines = a["el"].between(b["sl"], b["el"]) | a["sl"].between(b["sl"], b["el"])
    before = (a["el"] == b["sl"]) & (a["ec"] < b["sc"])
    after = (a["sl"] == b["el"]) & (a["sc"] > b["ec"])
    return lines & ~before & ~after


def overlap(a: Column, b: Column) -> Column:
    """Whether two span structs overlap; touching columns count."""
    return _one_way(a, b) | _one_way(b, a)


def without_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` (keys and ``span``) that overlap no ``span`` of ``right`` with the same keys."""
    mark = left.withColumn("__line", F.explode(F.sequence("span.sl", "span.el")))
    other = right.select(*keys, F.col("span").alias("__other"), F.explode(F.sequence("span.sl", "span.el")).alias("__line"))
    hit = mark.join(other, [*keys, "__line"]).filter(overlap(F.col("span"), F.col("__other"))).select(*keys, "span").distinct()
    return left.join(hit, [*keys, "span"], "left_anti")


def accepted_facts(results: Column, facts: Column) -> Column:
    """Facts in the order of their places, each kept unless it overlaps a result or a fact kept before."""
    return F.aggregate(
        F.array_sort(facts),
        F.slice(facts, 1, 0),
        lambda kept, f: F.when(F.exists(results, lambda r: overlap(r, f)) | F.exists(kept, lambda k: overlap(k, f)), kept).otherwise(F.concat(kept, F.array(f))),
    )


def covers(span: Column, token: Column) -> Column:
    """Whether a span holds a token, by the first rule that applies."""
    single = (token["sl"] == token["el"]) & (token["sl"] == span["sl"]) & (span["sc"] <= token["sc"]) & (span["ec"] >= token["ec"])
    several = F.when(token["sl"] == span["sl"], span["sc"] <= token["sc"]).when(token["el"] == span["el"], span["ec"] >= token["ec"]).otherwise((span["sl"] < token["sl"]) & (token["sl"] < span["el"]))
    return F.when(span["sl"] == span["el"], single).otherwise(several)


def labelled_tokens(tokens: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``tokens`` (keys, ``pos``, ``token`` struct) with ``label``: 0 B, 1 I, 2 O, 3 F.

    ``spans`` has keys, ``span``, ``rank`` and ``origin`` (0 result, 3 fact);
    of the spans that hold a token the one with the largest rank counts.  A
    token opens a run if it is the first or follows a token outside.
    """
    marks = spans.select(*keys, "span", "rank", "origin", F.explode(F.sequence("span.sl", "span.el")).alias("__line"))
    lines = tokens.withColumn("__line", F.explode(F.array_distinct(F.array("token.sl", "token.el"))))
    hits = lines.join(marks, [*keys, "__line"]).filter(covers(F.col("span"), F.col("token"))).groupBy(*keys, "pos").agg(F.max_by("origin", "rank").alias("__origin"))
    order = Window.partitionBy(*keys).orderBy("pos")
    joined = tokens.join(hits, [*keys, "pos"], "left")
    outside = F.lag(F.col("__origin").isNull(), 1, True).over(order)
    return joined.withColumn("label", F.when(F.col("__origin").isNull(), 2).when(outside, F.col("__origin")).otherwise(1)).drop("__origin")


def token_origins(tokens: Column, spans: Column) -> Column:
    """For each token (array of span structs) the origin of the span that holds it, of the largest rank; null outside.

    ``spans``: struct<span, rank, origin>, those that touch the tokens' lines.
    """
    found = lambda marks, t: F.array_max(F.transform(F.filter(marks, lambda m: covers(m["span"], t)), lambda m: F.struct(m["rank"], m["origin"])))
    return arrays.let(spans, lambda marks: F.transform(tokens, lambda t: found(marks, t)["origin"]))


def origin_labels(origins: Column) -> Column:
    """Labels of a file's tokens as arrays, one a line, from their origins: as ``labelled_tokens`` gives them, without a shuffle.  No line is empty."""

    def line(file, own, k):
        before = lambda i: F.when(i > 0, F.get(own, i - 1)).otherwise(F.try_element_at(F.get(file, k - 1), F.lit(-1)))
        return F.transform(own, lambda x, i: F.when(x.isNull(), 2).when(before(i).isNull(), x).otherwise(1))

    return arrays.let(origins, lambda file: F.transform(file, lambda own, k: line(file, own, k)))


def unusable(labels: Column, positive: Column) -> Column:
    """Why a file with these labels isn't usable, null if it is: positives need a result's first token, negatives must have none and nothing inside."""
    first, inside = F.array_contains(labels, 0), F.array_contains(labels, 1)
    return F.when(positive, F.when(~first, "no answer labelled")).otherwise(F.when(first | inside, "answer in a negative"))


def usable_labels(labelled: DataFrame, keys: Sequence[str], positive: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) files: positives need a result's first token, negatives must have none and nothing inside."""
    found = labelled.groupBy(*keys).agg(F.max((F.col("label") == 0).cast("int")).alias("b"), F.max((F.col("label") == 1).cast("int")).alias("i"), F.first(positive).alias("positive"))
    fine = F.when(F.col("positive"), F.col("b") == 1).otherwise((F.col("b") == 0) & (F.col("i") == 0))
    return found.filter(fine).select(*keys), found.filter(~fine).select(*keys, F.when(F.col("positive"), "no answer labelled").otherwise("answer in a negative").alias("error_type"))


def local_block(spans: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First block (by ``order``) whose ``lines`` hold both the first and last line of ``span``."""
    lines = blocks.select(*keys, "order", F.col("block_id"), F.explode("lines").alias("__line"))
    ids = spans.withColumn("__line", F.explode(F.array_distinct(F.array("span.sl", "span.el")))).withColumn("__need", F.size(F.array_distinct(F.array("span.sl", "span.el"))))
    hits = ids.join(lines, [*keys, "__line"]).groupBy(*keys, "span", "order", "block_id").agg(F.count("*").alias("__n"), F.first("__need").alias("__need")).filter("__n = __need")
    return hits.groupBy(*keys, "span").agg(F.min_by("block_id", "order").alias("block_id"))


def runs(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps and islands over long label rows (keys, ``pos``, ``label``): keys, tag, first, last of each run."""
    order = Window.partitionBy(*keys).orderBy("pos")
    numbered = labels.withColumn("__run", F.sum((F.col("label") != 1).cast("int")).over(order))
    return numbered.groupBy(*keys, "__run").agg(F.min_by("label", "pos").cast("int").alias("tag"), F.min("pos").alias("first"), F.max("pos").alias("last")).filter(F.col("tag").isin(0, 3)).drop("__run")
