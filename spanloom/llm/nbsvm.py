"""Quality by Naive Bayes support vectors.

Features are indicators of byte n-grams, hashed into ``2 ** BITS`` places.
Each is scaled by its class log-count ratio (smoothed log of how often rows of
class 1 have it, over rows of class 0); rows are brought to length one; a
linear hinge-loss model is fitted by dual coordinate descent.  A logistic
calibration on rows that the model hasn't seen turns margins into scores.

The fit uses at most ``MOST`` labelled rows of each class, by hash of the id,
of at most ``LONGEST`` bytes each and ``FIT_BYTES`` together; scores read whole
texts.

Cases: null and empty texts have no feature and get the score of a margin of
the bias alone; with too few labels of a class the score is the share of class
1 everywhere; repeated rows get equal scores, and of an id's texts the fit sees one; an empty
table gives no row; other columns aren't read by ``scores`` and kept by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import crc_mod, discard, map_arrow, texts_of

#: Labelled rows of each class to learn from at most.
MOST = {0: 2000, 1: 2500}
LONGEST, FIT_BYTES = 200_000, 48 << 20
#: Bits of the feature space, lengths of the byte n-grams, bytes hashed at once.
BITS, GRAMS, CHUNK = 18, (2, 3, 4), 1 << 20
#: Smoothing of the counts, cost of the hinge loss, passes.
ALPHA, COST, PASSES = 1.0, 1.0, 12


class Features:
    """Distinct hashed n-grams of texts; reuses one array of marks."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, bool)

    def of(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, len(data), CHUNK):
            x = data[at : at + CHUNK + GRAMS[-1] - 1].astype(np.uint32)
            run, n = x, 1
            for length in GRAMS:
                while n < length and len(run) > 1:
                    run, n = (run[:-1] << np.uint32(8)) | x[n:], n + 1
                if n == length:
                    self.seen[((run + np.uint32(length)) * np.uint32(2654435769)) >> np.uint32(32 - BITS)] = True
        found = np.flatnonzero(self.seen).astype(np.int32)
        self.seen[found] = False
        return found


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Class log-count ratios of all features."""
    p = [np.full(1 << BITS, ALPHA) for _ in (0, 1)]
    for x, c in zip(rows, y, strict=True):
        p[c][x] += 1
    return np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())


def hinge(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray, passes: int = PASSES, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights (before scaling by r) and bias of the linear model, by dual coordinate descent.  ``cost`` is of each row."""
    s = np.where(y > 0, 1.0, -1.0)
    values = [r[x] / max(1e-12, float(np.sqrt((r[x] ** 2).sum()))) for x in rows]
    w, bias, alpha = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = s[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])  # a row of length one and the bias's one: 2
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[x] += step * s[i] * v
                bias += step * s[i]
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w, bias


def margins(rows: list[np.ndarray], weights: np.ndarray, squares: np.ndarray, bias: float) -> np.ndarray:
    return np.array([float(weights[x].sum()) / max(1e-6, float(np.sqrt(squares[x].sum()))) + bias if len(x) else bias for x in rows])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: weights by feature, squares of the ratios, bias and calibration, or a constant score."""
    chosen, counts = labelled.sample(labels, label, MOST, folds, held_out, id_col)
    d, used = labelled.texts(docs, chosen, LONGEST, FIT_BYTES, id_col, text_col)

    def run(batches):
        features = Features()
        for b in batches:
            found = [features.of(t) for t in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "y", "x"])

    rows = sorted((r[0], r[1], bytes(r[2])) for r in map_arrow(d, run, "doc_id long, y int, x binary").collect())
    discard(used)
    y = np.array([r[1] for r in rows], np.int64)
    x = [np.frombuffer(r[2], np.int32) for r in rows]
    part = np.arange(len(y)) % 4 != 0  # three quarters fit the model, one the calibration
    if min([int((y[p] == c).sum()) for p in (part, ~part) for c in (0, 1)], default=0) < 1:
        return {"constant": labelled.prior(counts)}
    one, two = [v for v, p in zip(x, part, strict=True) if p], [v for v, p in zip(x, part, strict=True) if not p]
    r = log_ratios(one, y[part])
    w, bias = hinge(one, y[part], r, COST * labelled.balance(y[part], {c: 1 for c in (0, 1)}))
    model = {"weights": (w * r).astype(np.float32), "squares": (r * r).astype(np.float32), "bias": bias}
    m = margins(two, model["weights"], model["squares"], bias)
    model["calibration"] = labelled.logistic(m[:, None], y[~part].astype(float), labelled.balance(y[~part], counts), ridge=0.01)
    return model


def scores(docs: DataFrame, model: dict, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2 ** BITS floats: 2 MB

    def run(batches):
        features, m = Features(), shared.value
        for b in batches:
            texts = texts_of(b.column(2))
            if not texts:
                continue
            p = np.full(len(texts), m["constant"]) if "constant" in m else labelled.probability(m["calibration"], margins([features.of(t) for t in texts], m["weights"], m["squares"], m["bias"])[:, None])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "text")
    return map_arrow(d, run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject (score of one half or more).  A constant score, for lack of labels, rejects none."""
    shared, names, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns, docs.columns.index(text_col)

    def run(batches):
        features, m = Features(), shared.value
        for b in batches:
            texts = texts_of(b.column(at))
            if not texts:
                continue
            p = np.full(len(texts), 1.0) if "constant" in m else labelled.probability(m["calibration"], margins([features.of(t) for t in texts], m["weights"], m["squares"], m["bias"])[:, None])
            yield pa.RecordBatch.from_arrays(b.columns, names=names).filter(pa.array(p >= 0.5))

    return map_arrow(docs, run, docs.schema)
