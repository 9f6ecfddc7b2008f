"""Functions on label and token arrays.  Labels: 0 B, 1 I, 2 O, 3 F, 4 separator, query or pad."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

B, I, O, F_, PAD = 0, 1, 2, 3, 4  # noqa: E741


def let(value: Column, f) -> Column:
    """``f`` of a value that is made once, however often ``f`` and its lambdas read it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_separator(labels: Column) -> Column:
    """Index (0-based) of the first 4 that isn't followed by a 4; null without one.  The last place has no successor and doesn't count."""
    at = F.array_position(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x, i: (x == PAD) & (F.get(labels, i + 1) != PAD)), True)
    return F.nullif(at, F.lit(0)).cast("int") - 1


def segment_ids(tokens: Column, separator: Column) -> Column:
    """0 up to the first separator, itself included, then 1."""
    zeros = F.coalesce(F.nullif(F.array_position(tokens, separator).cast("int"), F.lit(0)), F.size(tokens))
    return F.concat(F.array_repeat(F.lit(0), zeros), F.array_repeat(F.lit(1), F.size(tokens) - zeros))


def fitted(values: Column, size: int, fill: Column) -> Column:
    """Cut or filled at the right to ``size``."""
    return F.slice(F.concat(values, F.array_repeat(fill, size)), 1, size)


def n_windows(values: Column, prefix: Column, width: int) -> Column:
    """How many chunks ``windows`` gives."""
    return F.when(F.size(values) < width, 1).otherwise(F.ceil((F.size(values) - prefix) / (F.lit(width) - prefix))).cast("int")


def window(values: Column, number: Column, prefix: Column, width: int) -> Column:
    """The chunk ``number`` (from 0) of ``windows``, for rows that hold one each."""
    body = F.lit(width) - prefix
    return F.when(F.size(values) < width, values).otherwise(F.concat(F.slice(values, F.lit(1), prefix), F.slice(values, prefix + number * body + 1, body)))


def windows(values: Column, prefix: Column, width: int) -> Column:
    """Chunks of at most ``width``, each led by the first ``prefix`` elements; a shorter array is its own chunk.  They overlap in the prefix alone."""
    body = F.lit(width) - prefix
    n = F.ceil((F.size(values) - prefix) / body).cast("int")
    cut = lambda s: F.concat(F.slice(values, F.lit(1), prefix), F.slice(values, prefix + s * body + 1, body))
    return F.when(F.size(values) < width, F.array(values)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), cut))


def rejoined(chunks: Column, prefix: Column) -> Column:
    """The array that ``windows`` cut: later chunks lose their prefix."""
    return F.flatten(F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.slice(c, prefix + 1, F.size(c)))))


def joined(blocks: Column, separator: Column) -> Column:
    """Arrays in a row with a separator between them."""
    spaced = F.flatten(F.transform(blocks, lambda b: F.concat(b, F.array(separator))))
    return F.slice(spaced, 1, F.greatest(F.size(spaced) - 1, F.lit(0)))


def spans(labels: Column) -> Column:
    """Runs that open at 0 or 3 and go on over 1s: array of struct<tag, first, last>, 0-based and inclusive.  Stray 1s open nothing."""
    marked = F.transform(labels, lambda x, i: F.struct(x.cast("int").alias("tag"), i.alias("at")))
    breaks = F.filter(marked, lambda s: s["tag"] != I)
    # a run ends before the next break, which is the next element: one pass
    ends = F.concat(F.transform(F.slice(breaks, F.lit(2), F.greatest(F.size(labels), F.lit(1))), lambda s: s["at"]), F.array(F.size(labels)))
    runs = F.zip_with(breaks, ends, lambda s, e: F.struct(s["tag"].alias("tag"), s["at"].alias("first"), (e - 1).cast("int").alias("last")))
    return F.filter(runs, lambda s: s["tag"].isin(B, F_))


def of_kind(found: Column, kind: str) -> Column:
    """Spans of ``kind``: answer, sf or both."""
    if kind == "both":
        return found
    return F.filter(found, lambda s: s["tag"] == {"answer": B, "sf": F_}[kind])


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets; two empty ones are equal."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def same_bag(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def line_list(start: Column, end: Column, others: Column) -> Column:
    """Lines of a block: those given, or from start to end."""
    return F.when(F.size(others) > 0, others).otherwise(F.sequence(start, end))


def cut_every(lines: Column, size: int) -> Column:
    """Arrays (one a line) in blocks of ``size`` lines, each as one array."""
    return let(lines, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda k: F.flatten(F.slice(x, k * size + 1, size))))


def best_label(scores: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def opened(labels: Column, origins: Column) -> Column:
    """1s at the start or after a 2 become their origin's letter."""
    return F.transform(labels, lambda x, i: F.when((x == I) & ((i == 0) | (F.get(labels, i - 1) == O)), F.get(origins, i)).otherwise(x))
