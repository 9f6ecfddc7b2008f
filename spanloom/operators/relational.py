"""Joins and groupings that prepare a dataset.

Which side of a join is broadcast is left to Spark, which knows the sizes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of_each(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the largest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row")).select(*keys, "__row.*")


def resolved(results: DataFrame, programs: DataFrame, queries: DataFrame, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Results joined to their program and query, and the rejects with the reason."""
    known = programs.select(path).distinct().withColumn("__p", F.lit(True))
    named = queries.select(name).distinct().withColumn("__q", F.lit(True))
    marked = results.join(known, path, "left").join(named, name, "left")
    rejects = marked.filter("__p IS NULL OR __q IS NULL").select(*results.columns, F.when(F.col("__p").isNull(), "unknown path").otherwise("unknown query").alias("error_type"))
    return results.join(programs, path).join(queries, name), rejects


def merged(results: DataFrame, keys: Sequence[str], location: Column, order: Column) -> DataFrame:
    """Locations of each (file, query), in order."""
    return results.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), location.alias("v")))), lambda x: x["v"]).alias("locations"))


def split_rejects(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all of ``columns``, and those that lack one."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.filter(whole), df.filter(~whole).withColumn("error_type", F.lit("missing coordinate"))


def merged_relevance(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each block of a (file, query): relevant if it is in any result; stubs are left out."""
    return blocks.filter("block_type <> 'STUB'").groupBy(*keys).agg(F.bool_or("relevant").alias("relevant"))


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` by its keys in ``parts`` partitions, or as many as the session has, if those are more."""
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def merged_groups(groups: DataFrame) -> DataFrame:
    """Groups of one ``group_id`` become the first (by ``order``); its labels of 2 take the first other label at their place.

    ``groups``: group_id, order, labels.  Labels are merged by position before the shuffle ends, so a frequent group isn't gathered.
    """
    long = groups.select("group_id", "order", F.posexplode("labels").alias("pos", "label"))
    best = long.groupBy("group_id", "pos").agg(F.min_by("label", F.struct(F.col("label") == 2, "order")).alias("label"))
    first = groups.groupBy("group_id").agg(F.min("order").alias("order"), F.min_by(F.size("labels"), "order").alias("n"))
    return best.join(first, "group_id").filter("pos < n").groupBy("group_id", "order").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("labels"))


def with_relevance_of_same_lines(blocks: Column) -> Column:
    """Blocks (struct with ``lines`` and ``relevant``) without repeats of the same lines, relevant if any of them was."""
    return F.transform(
        F.filter(blocks, lambda b, i: ~F.exists(F.slice(blocks, 1, i), lambda a: a["lines"] == b["lines"])),
        lambda b: b.withField("relevant", F.exists(blocks, lambda a: (a["lines"] == b["lines"]) & a["relevant"])),
    )


def row_index(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``idx``, the rank of a row from 0 by a unique ``key``, without gathering the rows.

    Ranks are counted within ranges of the key, as many as the session has
    shuffle partitions; where a range begins comes from the counts of the ranges.
    """
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], F.lit(max(10_000, 20 * parts))).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    side = max(1, math.isqrt(len(cuts)))
    # two steps: the group of bounds, then the bound in it
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)] or [[]]
    kind = f"array<{df.schema[key].dataType.simpleString()}>"
    listed = lambda xs: F.array(*(F.lit(x) for x in xs)).cast(kind)
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col(key)))
    group = below(listed([g[0] for g in groups if g]))  # 0: before all bounds
    inner = below(F.get(F.array(listed([]), *(listed(g) for g in groups)), group))
    ranged = df.withColumn("__part", F.greatest(group - 1, F.lit(0)) * side + inner)
    counts = ranged.groupBy("__part").count()
    before = counts.select("__part", (F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return ranged.withColumn("__n", within).join(F.broadcast(before), "__part").withColumn("idx", F.col("__n") + F.coalesce("__before", F.lit(0))).drop("__part", "__n", "__before")


def contiguous_splits(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows in the order of ``key`` dealt to k splits (``split_id`` from 1) of neighbouring rows."""
    n = df.count()
    return row_index(df, key).withColumn("split_id", F.ceil((F.col("idx") + 1) * k / F.lit(max(n, 1))).cast("int"))


def flat_manifest(df: DataFrame, column: str) -> DataFrame:
    """Paths of a JSON manifest: an array of objects with ``filepath``."""
    return df.select(F.explode(F.from_json(column, "array<struct<filepath:string>>")).alias("x")).select("x.filepath")


def both_kinds(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Union of examples; each side must be of its own type, else the query fails when it runs."""
    check = lambda df, t: df.withColumn("example_type", F.when(F.col("example_type") == t, F.col("example_type")).otherwise(F.raise_error(F.lit(f"an example isn't of type {t}")).cast("int")))
    return check(positive, 1).unionByName(check(negative, 0))
