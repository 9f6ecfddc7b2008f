"""Exact top-k inner products by Fagin's threshold algorithm.

A block of candidates keeps, for each dimension, its vectors sorted by that
component.  For a query the lists are walked together from the end that its
component's sign favours.  After depth d no vector unseen can score more than
the sum of query components times the lists' values at d; once that is below
the k-th score so far the walk stops, as it does when all were seen.  Equal bounds go on, as a tie might have
the smaller id.  Scores are exact integers.

Queries and candidates meet in pairs of blocks of bounded size; the k best of
each pair are merged by id of the query.  No side is broadcast.

Cases: vectors that are null, or hold null or non-finite components, take no
part; vectors of different lengths don't meet; a row of the query's own id is
no candidate, repeated rows included; repeated candidate rows count once for
each row; repeated query rows ask once, and an id with several vectors gets the
best of all; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tune

#: Candidates and queries of a block; first depth of a walk and its growth.
CANDIDATES, QUERIES, DEPTH, GROWTH = 16_384, 4096, 8, 2


def integers(df: DataFrame, vec: str, scale: float) -> DataFrame:
    """Adds ``v``, the components times ``scale``, rounded down; rows whose vector can't take part go."""
    double = F.transform(vec, lambda x: x.cast("double"))
    fine = ~F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(vec).isNotNull()).filter(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform(double, lambda x: F.floor(x * scale).cast("long")))


class SortedLists:
    """A block of candidates with its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        self.lists = np.argsort(self.x, axis=0, kind="stable")  # ascending, one column for each dimension
        self.values = np.take_along_axis(self.x, self.lists, axis=0)
        most = float(np.abs(self.x).astype(np.float64).max(initial=0)) * max(1, self.x.shape[1])
        self.most, self.doubles = most, self.x.astype(np.float64) if most < 2**52 else None

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.doubles is not None and self.most * float(np.abs(q).max(initial=0)) < 2**52:  # sums are exact in doubles
            return (self.doubles[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ q

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Ids and scores of the k best, and the share of the block that was seen when the walk ended."""
        n, up = len(self.ids), q >= 0
        used = np.flatnonzero(q)
        seen = np.zeros(n, bool)
        ids, best, depth, was = np.empty(0, np.int64), np.empty(0, np.int64), min(DEPTH, n), 0
        while True:
            near = np.where(up[used], 1, 0)
            new = np.zeros(n, bool)
            for d, high in zip(used, near, strict=True):
                part = self.lists[n - depth : n - was, d] if high else self.lists[was:depth, d]
                new[part] = True
            if not len(used) or depth == n:
                new[:] = True
            rows = np.flatnonzero(new & ~seen)
            seen |= new
            rows = rows[self.ids[rows] != query_id]
            ids, best = np.concatenate([ids, self.ids[rows]]), np.concatenate([best, self.scores(q, rows)])
            if len(ids) > k:
                if len(ids) > 4 * k:  # all that tie with the k-th stay for the sort
                    stay = best >= np.partition(best, len(best) - k)[len(best) - k]
                    ids, best = ids[stay], best[stay]
                order = np.lexsort((ids, -best))[:k]
                ids, best = ids[order], best[order]
            if depth == n or seen.all():
                break
            edge = np.where(up, self.values[n - depth], self.values[depth - 1])
            if len(ids) >= k and sum(int(a) * int(b) for a, b in zip(q[used], edge[used], strict=True)) < best.min():
                break
            was, depth = depth, min(n, depth * GROWTH)
        order = np.lexsort((ids, -best))[:k]
        return ids[order], best[order], float(seen.mean()) if n else 1.0


def top_k(vectors: DataFrame, k: int, is_query, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row for which the column ``is_query`` holds."""
    spark = vectors.sparkSession
    tune(spark)
    rows = integers(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vec", scale).filter("vec_id IS NOT NULL").withColumn("dim", F.size("v")).drop("vec")
    sizes = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, asked = max(1, -(-sizes[0] // CANDIDATES)), max(1, -(-sizes[1] // QUERIES))
    c = rows.select("dim", "vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("qb"))
    q = rows.filter("asks").dropDuplicates(["dim", "vec_id", "v"]).select("dim", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(asked)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))

    def meet(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            lists = SortedLists(candidates["vec_id"].to_numpy(np.int64), np.stack(candidates["v"].to_numpy()))
            for i, v in zip(queries["vec_id"], queries["v"], strict=True):
                ids, best, _ = lists.top(int(i), np.asarray(v, np.int64), k)
                out.append(pd.DataFrame({"query_id": int(i), "vec_id": ids, "score": best}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    found = c.groupBy("dim", "cb", "qb").cogroup(q.groupBy("dim", "cb", "qb")).applyInPandas(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
