"""Document fingerprints from closed syncmers.

A k-mer of code points is a *closed syncmer* if the smallest of its inner
s-mers (by hash) stands first or last in it.  The choice looks at the k-mer
alone, so equal passages give equal anchors wherever they stand, and a
position can be compared to a position.

Cases: a null text is the empty text; a text of fewer than ``K`` code points
has one anchor, the hash of the whole; the empty text has none.  Equal texts
have equal anchors and fingerprints.  Long texts go through in blocks, so the
working memory is bounded by the block and by the number of anchors kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts_of, width

#: Code points of a k-mer and of its inner s-mers; hashes kept of a fingerprint; code points handled at once.
K, S, SKETCH, BLOCK = 16, 8, 128, 1 << 20
_A = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> list[np.uint64]:
    out, a = [], int(_A)
    for _ in range(n):
        out.append(np.uint64(a))
        a = a * a & (1 << 64) - 1
    return out


_POW = _powers(8)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    """Code points; a lone surrogate stands for itself."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _doubled(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` elements, n a power of two: a run's hash joins those of its halves."""
    step = 1
    for a in _POW:
        if step == n:
            return x
        x = x[:-step] * a + x[step:]
        step *= 2
    raise ValueError("n must be a power of two up to 256")


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of ``n``."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) and positions of the closed syncmers of ``text``, in the order of the text.

    >>> h, at = anchors("a text of some more than sixteen code points")
    >>> bool(len(h) and (at[1:] > at[:-1]).all())
    True
    """
    n = len(text)
    if n < k:
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.array([xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7)], np.uint64), np.zeros(1, np.int64)
    points, hashes, places = code_points(text), [], []
    for begin in range(0, n - k + 1, BLOCK):
        x = _mix(points[begin : begin + BLOCK + k - 1].astype(np.uint64) + np.uint64(1))
        inner = _doubled(x, s)
        order = _mix(inner)
        least = _least(order, k - s + 1)
        m = len(least)
        chosen = np.flatnonzero((order[:m] == least) | (order[k - s : k - s + m] == least))
        # a k-mer's hash joins those of its first and last s-mer runs
        whole = _doubled(x, k)[chosen]
        hashes.append(_mix(whole))
        places.append(chosen + begin)
    return np.concatenate(hashes), np.concatenate(places).astype(np.int64)


def sketch(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Upper halves of the ``size`` smallest distinct hashes, ascending."""
    if len(hashes) > 8 * size:
        few = np.unique(np.partition(hashes, 2 * size)[: 2 * size])
        if len(few) >= size:
            return few[:size] >> np.uint64(32)
    return np.unique(hashes)[:size] >> np.uint64(32)


def fingerprint(text: str) -> str:
    """Eight hex digits for each hash kept (its upper half), ascending; empty for the empty text."""
    return sketch(anchors(text)[0]).astype(">u4").tobytes().hex()


def likeness(a: str, b: str, size: int = SKETCH) -> float:
    """Estimated Jaccard likeness of the anchors behind two fingerprints, 0 to 1; 1 if both are empty."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(v), ">u4") for v in (a, b))
    both = np.unique(np.concatenate([x, y]))[:size]
    return float(np.count_nonzero(np.isin(both, x) & np.isin(both, y)) / len(both))


def matches(a: str, b: str) -> list[tuple[int, int]]:
    """Positions (in ``a``, in ``b``) of the anchors that the two texts share, first places only."""
    (ha, pa_), (hb, pb) = anchors(a), anchors(b)
    ua, ia = np.unique(ha, return_index=True)
    ub, ib = np.unique(hb, return_index=True)
    _, x, y = np.intersect1d(ua, ub, return_indices=True)
    return sorted((int(pa_[ia[i]]), int(pb[ib[j]])) for i, j in zip(x, y, strict=True))


def edited(text: str, following: str) -> str:
    """``text`` whose last third is replaced by as many first code points of ``following``, or all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut] if cut else text


def with_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, the hashes (signed) and positions of its anchors, its fingerprint."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), texts_of(b.column(1))
            found = [anchors(t) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64())), pa.array([sketch(h).astype(">u4").tobytes().hex() for h, _ in found], pa.string())], names=["doc_id", "hashes", "positions", "fingerprint"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, hashes array<long>, positions array<long>, fingerprint string")


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likenesses.

    The next document is the one of the next smaller id; after the last comes
    the first.  Rows of one id follow one another by the bytes of their compressed texts; null ids come last.

    One shuffle: rows go to ranges of ids whose bounds are ids that occur, so
    a mapper knows which rows open a range and sends a second copy of them to
    the range before, where the last row needs its successor.  Texts travel
    compressed, with the fingerprint that the mapper made.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = width(docs)
    cuts = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], F.lit(max(10_000, 20 * n))).alias("q"), F.max("doc_id").alias("top"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    top = cuts["top"]
    # descending first ids of the ranges after the first one
    bounds = sorted({x for x in cuts["q"] or [] if x != top}, reverse=True)
    last, climbing = len(bounds), np.array(bounds[::-1], np.int64)
    first_null = top is None

    def route(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            rows = []
            for i, t in zip(ids, texts, strict=True):
                # how many bounds are at or above the id
                part = last if i is None else last - int(np.searchsorted(climbing, i, "left"))
                raw = t.encode("utf-8", "surrogatepass")
                row = (part, i, 0, pack.compress(raw), fingerprint(t))
                rows.append(row)
                if i is not None and part and bounds[part - 1] == i:
                    rows.append((part - 1, i, 1, *row[3:]))
                if i == top or (first_null and i is None):
                    rows.append((last, i, 2, *row[3:]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "doc_id", "copy", "z", "fp"])

    def pair(batches):
        unpack, held, sha = zstandard.ZstdDecompressor(), None, hashlib.sha256
        for b in batches:
            out = []
            for i, copy, z, fp in zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True):
                if held is None and copy:
                    continue
                text = unpack.decompress(z, max_output_size=0 if len(z) else 1).decode("utf-8", "surrogatepass")
                if held is not None:
                    out.append((*held, text, fp))
                held = None if copy else (i, text, fp)
            yield batch_of(out, sha)

    def batch_of(rows, sha):
        cols = [[] for _ in range(7)]
        for i, text, fp, after, fp_after in rows:
            changed = edited(text, after)
            fp_changed = fp if changed == text else fingerprint(changed)
            for c, v in zip(cols, (i, len(text), sha(changed.encode("utf-8", "surrogatepass")).hexdigest(), fp, fp_changed, likeness(fp, fp_changed), likeness(fp, fp_after)), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    routed = map_arrow(d, route, "part int, doc_id long, copy int, z binary, fp string")
    # a range's own rows by id, then its copies: of the next range's first rows, or of the very first
    placed = routed.repartitionById(last + 1, F.col("part")).sortWithinPartitions(F.col("copy") == 2, F.col("doc_id").desc_nulls_last(), "z")
    return map_arrow(placed, pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
