"""Bounded, repeatable samples of labelled rows, and a small logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize


def sample(labels: DataFrame, label: str, most: dict[int, int], folds: int, held_out: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of the rows to learn from: of each class at most ``most`` ids with the smallest hashes, none of them held out; and how many ids each class has.

    Null labels are left out; an id labelled twice counts once, with the larger label.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(crc_mod("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in most.items()]
    return parts[0].unionByName(parts[1]), {0: counts.get(0, 0), 1: counts.get(1, 0)}


def texts(docs: DataFrame, chosen: DataFrame, longest: int, total: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, y, text) of the chosen ids, and the table to discard after use: texts of at most ``longest`` bytes, one for each id (of several the first by MD5), in the order of the ids' hashes until ``total`` bytes are reached."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    found = d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))
    found = materialize(found, "labelled")
    sizes = found.select(F.xxhash64("doc_id"), "doc_id", F.octet_length("text")).collect()  # no more than chosen
    ids, used = [], 0
    for _, i, n in sorted(tuple(r) for r in sizes):
        used += n
        if used > total:
            break
        ids.append((i,))
    few = docs.sparkSession.createDataFrame(ids, "doc_id long")
    return found.join(F.broadcast(few), "doc_id").select("doc_id", "y", "text"), found


def balance(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the sample's classes the shares they have among all labels; mean 1."""
    w = np.ones(len(y))
    for c in (0, 1):
        if n := int((y == c).sum()):
            w[y == c] = counts[c] / n
    return w / w.mean() if len(w) else w


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the intercept last) of a ridge logistic fit by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    b, pen = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + pen + 1e-9 * np.eye(len(b)), z.T @ (w * (y - p)) - pen @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def probability(fit, x: np.ndarray) -> np.ndarray:
    mean, scale, b = fit
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ b[:-1] + b[-1], -30, 30)))


def prior(counts: dict[int, int]) -> float:
    """Share of class 1, drawn to one half by two rows."""
    return (counts[1] + 1) / (counts[0] + counts[1] + 2)
