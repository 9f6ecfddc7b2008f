"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on
toxic text.  A text is cut into windows of ``WINDOW`` words; a window's gain is
the bytes that the toxic dictionary, laid before the ordinary one, saves over
the ordinary one alone, so a window without toxic strings costs the same with
either.  Largest gains, mean gain, and how many windows gain and how much, go
through a logistic calibration fitted on labelled rows that the dictionaries
haven't seen; a score of one half is the threshold.

A toxic row is mostly ordinary words, and a dictionary trained on all of it is
an ordinary one (the README has figures).  So the toxic dictionary is trained
on those words of toxic rows that hold byte 5-grams which toxic rows have much
more often, each context (a word with its neighbours) counted once, so that
copies don't count.

The fit uses at most ``TOXIC`` and ``ORDINARY`` labelled rows, by hash of the
id, of at most ``LONGEST`` bytes each and ``FIT_BYTES`` together; of these the
ordinary dictionary takes ``WINDOWS`` windows at most, the toxic one ``REPEATS``
of each word.  Scores read whole texts.

Cases: null and empty texts have no gain and get the score that follows; with
no label of a class the score is the share of toxic labels everywhere;
repeated rows get equal scores, and of an id's texts the fit sees one; words
beyond ``WORD_BYTES`` are cut, so a window has a bound; an empty table gives no
row; other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import crc_mod, discard, map_arrow, texts_of

#: Labelled rows of each class to learn from at most, and the bytes of the longest used.
TOXIC, ORDINARY, LONGEST, FIT_BYTES = 2000, 4000, 200_000, 64 << 20
#: Windows of ordinary text that train its dictionary, their words, and repeats of a word that train the toxic one.
WINDOWS, TRAINED, REPEATS = 4000, 12, 50
#: Words of a window, bytes of a word; bytes of the dictionaries; level, shortest match and table sizes of the compressor.
WINDOW, WORD_BYTES, TOXIC_BYTES, ORDINARY_BYTES, LEVEL, MATCH, LOG = 8, 1024, 4096, 16_384, 12, 4, 17
#: Gain of a window that counts as strong; largest that is told apart.
STRONG, TOP = 2, 12
#: Length of the grams; how often, and how many times as often, a toxic gram must occur.
GRAM, LEAST, RATIO = 5, 8, 8.0
_TABLES_END = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])  # ends the entropy tables of a trained dictionary


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Runs of words with a space at both ends, and one of no word for a text without any."""
    w = words(text)
    if max(map(len, w), default=0) > WORD_BYTES:
        w = [x[i : i + WORD_BYTES] for x in w for i in range(0, len(x), WORD_BYTES)]
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(0, len(w), size)] or [b""]


def _grams(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}


def contrast(texts: list[str], y: np.ndarray) -> dict[bytes, float]:
    """Grams that toxic texts have more often than ordinary ones, with their weight of evidence."""
    ids: dict[bytes, int] = {}
    per: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for t, c in zip(texts, y, strict=True):
        x = np.array([0, *(ids.setdefault(w, len(ids) + 1) for w in words(t)), 0], np.uint64)
        a, b, c_ = x[:-2], x[1:-1], x[2:]
        key = (a * np.uint64(0x9E3779B97F4A7C15) ^ c_ * np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64((1 << 40) - 1)
        per[int(c)].append(np.unique(key << np.uint64(24) | b & np.uint64((1 << 24) - 1)))
    counts, totals = {}, {}
    for c, parts in per.items():
        seen = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        counts[c] = np.bincount((seen & np.uint64((1 << 24) - 1)).astype(np.int64), minlength=len(ids) + 1)
        totals[c] = max(1, len(seen))
    grams: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for w, i in ids.items():
        i &= (1 << 24) - 1
        if counts[1][i]:
            for g in _grams(w):
                grams[1][g] += int(counts[1][i])
    for w, i in ids.items():
        i &= (1 << 24) - 1
        if counts[0][i]:
            for g in _grams(w) & grams[1].keys():
                grams[0][g] += int(counts[0][i])
    out = {}
    for g, a in grams[1].items():
        expected = (grams[0][g] + 0.5) / totals[0] * totals[1]
        if a >= LEAST and a > RATIO * expected:
            out[g] = a * math.log(a / expected)
    return out


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content of a dictionary trained on the samples, without its tables; where there are too few to train on, their end."""
    try:
        whole = zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    at = whole.find(_TABLES_END)
    return whole[at + len(_TABLES_END) :] if at >= 0 else whole


class Distance:
    """Gains of windows under two dictionaries' contents."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.with_toxic, self.without = self._compressor(toxic + ordinary), self._compressor(ordinary)

    @staticmethod
    def _compressor(content: bytes):
        found = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=1024, dict_size=len(content), min_match=MATCH, window_log=LOG, hash_log=LOG, chain_log=LOG, write_content_size=False, write_checksum=False, write_dict_id=False)
        found.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=found, compression_params=how)

    def features(self, text: str) -> tuple[float, ...]:
        one, two = self.without.compress, self.with_toxic.compress
        known: dict[bytes, int] = {}
        gains = []
        for w in windows(text):
            g = known.get(w)
            if g is None:
                g = known[w] = len(one(w)) - len(two(w))
                if len(known) > 4096:
                    known.clear()
            gains.append(g)
        d = np.array(gains, np.float64)
        strong = d[d >= STRONG]
        return float(min(d.max(), TOP)), float(min(np.sort(d)[-2:].mean(), TOP)), float(np.clip(d.mean(), -5, 10)), len(strong) / math.sqrt(len(d)), math.log1p(float(strong.sum())), math.log1p(len(d))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: contents of the dictionaries and the calibration, or a constant score."""
    chosen, counts = labelled.sample(labels, label, {1: TOXIC, 0: ORDINARY}, folds, held_out, id_col)
    d, used = labelled.texts(docs, chosen, LONGEST, FIT_BYTES, id_col, text_col)
    rows = sorted((r[0], r[2], r[1]) for r in d.collect())
    discard(used)
    constant = {"constant": labelled.prior(counts)}
    texts, y = [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)
    if min(int((y == 0).sum()), int((y == 1).sum())) < 4:
        return constant
    part = np.arange(len(y)) % 3 != 0  # two thirds train the dictionaries, one the calibration
    if len(set(y[~part])) < 2:
        return constant
    rng = np.random.default_rng(7)
    evidence = contrast([t for t, p in zip(texts, part, strict=True) if p], y[part])
    toxic: list[bytes] = []
    for w, n in sorted(Counter(w for t, p, c in zip(texts, part, y, strict=True) if p and c for w in words(t)).items()):
        if not evidence.keys().isdisjoint(_grams(w)):
            toxic += [b" " + w + b" "] * min(n, REPEATS)
    if not toxic:
        return constant
    ordinary = [w for t, p, c in zip(texts, part, y, strict=True) if p and not c for w in windows(t, TRAINED)]
    ordinary = [ordinary[i] for i in rng.permutation(len(ordinary))[:WINDOWS]]
    model = {"toxic": _trained([toxic[i] for i in rng.permutation(len(toxic))], TOXIC_BYTES, 16, 6), "ordinary": _trained(ordinary, ORDINARY_BYTES, 64, 8)}
    distance = Distance(model["toxic"], model["ordinary"])
    x = np.array([distance.features(t) for t, p in zip(texts, part, strict=True) if not p])
    model["calibration"] = labelled.logistic(x, y[~part].astype(float), labelled.balance(y[~part], counts))
    return model


def scores(docs: DataFrame, model: dict, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches):
        distance = None if "constant" in model else Distance(model["toxic"], model["ordinary"])
        for b in batches:
            texts = texts_of(b.column(2))
            if not texts:
                continue
            p = np.full(len(texts), model["constant"]) if distance is None else labelled.probability(model["calibration"], np.array([distance.features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "text")
    return map_arrow(d, run, "doc_id long, held_out boolean, score double, predicted int")
