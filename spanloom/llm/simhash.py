"""SimHash near-duplicates: fingerprints of 64 bits or more, exact comparison in tiles.

Two fingerprints link when they differ in at most ``radius`` bits.

* Exact copies share a fingerprint, so distinct fingerprints alone are compared.
* Tables of bit positions part them into buckets of about ``UNIT``: with one
  bucket all meet all; beyond, ``exact_tables`` takes bits of radius + 1 blocks,
  of which one at least agrees between linked fingerprints, so no link is lost;
  ``sampled_tables``, for a radius too wide for that, takes as many samples of
  bits as bring pairs of a given similarity together but for a share ``miss``.
* A bucket is a list of fingerprints in the order of their population counts,
  cut into tiles.  numpy compares two tiles by exclusive-or and bit counts, and
  tile pairs whose counts differ by more than the radius are skipped, as they
  can hold no link.
* A bucket of more than ``TILE`` fingerprints is dealt over several tasks, a
  task for each pair of tiles that isn't too far apart.  Before that, what links
  to one of ``LEADERS`` of the bucket is joined to it, and tiles of one leader's
  cluster aren't compared with each other: they are connected already.  So a
  large group of near copies costs as much as its size, not its square.
* Within a task a union-find keeps a spanning forest of the links: components
  are whole, and the rows stay below the number of fingerprints compared.
* Components over all tasks come from alternating large-star and small-star
  rounds on the edges, written to the shared folder each time.

Cases: a null text is the empty text; a text without words has fingerprint
zero, linked like any other; fewer words than a shingle make one shingle;
repeated rows and ties share a fingerprint; an empty table gives no row; other
columns aren't read.  Null ids are ignored as a smallest id, if a component has
others.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, texts_of, width

#: Bits that may differ; words of a shingle; seed of the shingle hash.
RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints aimed at in a bucket, and of a tile that a task holds; a tile's side within a task.
UNIT, TILE, SIDE = 4096, 16_384, 256
#: Shingles hashed at once; groups up to this size are compared by shifting; leaders of a large bucket.
CHUNK, SMALL, LEADERS = 1 << 17, 8, 16
#: Rows that are broadcast at most.
FEW = 100_000


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of 64 bits, as an unsigned number.

    >>> simhash(""), simhash("a b") == simhash("A  B")
    (0, True)
    """
    return int(fingerprint(text, shingle)[0])


def fingerprint(text: str, shingle: int = SHINGLE, parts: int = 1) -> np.ndarray:
    """``parts`` numbers of 64 bits; the first is the SimHash of the shingles' XXH64, the others that of mixtures of it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(parts, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.concatenate([_mixed(np.array([digest(joined, SEED)], np.uint64), k) for k in range(parts)])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    ones = np.zeros((parts, 64), np.int64)
    for at in range(0, n, CHUNK):
        stop = min(n, at + CHUNK)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at:stop].tolist(), ends[at + shingle - 1 : stop + shingle - 1].tolist(), strict=True)], np.uint64)
        for k in range(parts):
            ones[k] += _bit_sums(_mixed(h, k))
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash behind each hash: itself, then finalisers of splitmix64."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each bit set, bit 0 first."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
    out = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        out += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return out


def _names(parts: int) -> list[str]:
    return [f"f{k}" for k in range(parts)]


def _columns(table: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c).view(np.int64), pa.int64()) for c in table.T]


def fingerprints(docs: DataFrame, keep: Sequence[str], text: str, shingle: int = SHINGLE, parts: int = 1) -> DataFrame:
    """The columns ``keep`` of ``docs``, and ``f0``.. with the fingerprint of ``text``, as signed longs."""

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t, shingle, parts) for t in texts_of(b.column(len(keep)))], np.uint64).reshape(-1, parts)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *_columns(found)], names=[*keep, *_names(parts)])

    d = docs.select(*keep, text)
    kinds = [f"{c} {d.schema[c].dataType.simpleString()}" for c in keep]
    return map_arrow(d, run, ", ".join([*kinds, *(f"{n} long" for n in _names(parts))]))


def exact_tables(n: int, radius: int, parts: int = 1, unit: int = UNIT) -> list[list[int]]:
    """Bit positions of radius + 1 blocks: linked fingerprints agree in one of them.  One table without a bit if n are few."""
    wide = 64 * parts // (radius + 1)
    b = min(wide, max(0, math.ceil(math.log2(max(1, n) / unit))))
    return [list(range(k * wide, k * wide + b)) for k in range(radius + 1)] if b else [[]]


def difference(jaccard: float) -> float:
    """Chance that a bit differs between sets of equal size of that similarity: their angle as a part of a half turn."""
    return math.acos(2 * jaccard / (1 + jaccard)) / math.pi


def sampled_tables(n: int, jaccard: float, parts: int, miss: float = 0.01, unit: int = UNIT) -> list[list[int]]:
    """Samples of bit positions; as many that sets of that similarity agree in none with a chance of ``miss`` at most."""
    b = max(0, math.ceil(math.log2(max(1, n) / unit)))
    if not b:
        return [[]]
    agree = (1 - difference(jaccard)) ** b
    rng = np.random.default_rng(SEED)
    return [sorted(rng.choice(64 * parts, b, replace=False).tolist()) for _ in range(math.ceil(math.log(miss) / math.log1p(-agree)))]


def _pop(f: np.ndarray) -> np.ndarray:
    """Population counts of rows of numbers."""
    return np.bitwise_count(f).sum(-1, dtype=np.int16)


def _in_tables(batches, tables: list[list[int]], parts: int):
    """Rows (key, f0..) to one row (bucket, key, f0.., pop) for each table.  A bucket is the table's number and its bits (as many in each table)."""
    for batch in batches:
        f = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], axis=1)
        pop = pa.array(_pop(f), pa.int16())
        for t, bits in enumerate(tables):
            code = np.full(len(f), t, np.uint64)
            for bit in bits:
                code = code << np.uint64(1) | f[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64), pa.int64()), *batch.columns, pop], names=["bucket", "key", *_names(parts), "pop"])


def _forest(n: int, pairs) -> np.ndarray:
    """Roots (smallest index) of n nodes under batches of linked index pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows within ``radius`` bits; two numbers of each decide for most, as a part can't differ in more than the whole."""
    d = np.bitwise_count(x[:, 0, None] ^ y[None, :, 0])
    if x.shape[1] == 1:
        return np.nonzero(d <= radius)
    d = d + np.bitwise_count(x[:, 1, None] ^ y[None, :, 1])
    i, j = np.nonzero(d <= radius)
    fine = _pop(x[i] ^ y[j]) <= radius
    return i[fine], j[fine]


def tile_links(left: np.ndarray, right: np.ndarray | None = None, radius: int = RADIUS, side: int = SIDE, skipped: list | None = None):
    """Batches of index pairs (into left, into right or left) of fingerprints (rows of numbers) within ``radius`` bits.

    Both sides must be sorted by population count; pairs of tiles whose counts
    differ by more than the radius are skipped.  ``skipped`` gets, for each
    pair of tiles, whether it was.
    """
    within = right is None
    right = left if within else right
    pl, pr = _pop(left), _pop(right)
    for a in range(0, len(left), side):
        x = left[a : a + side]
        for b in range(a if within else 0, len(right), side):
            y = right[b : b + side]
            far = pr[b] - pl[a + len(x) - 1] > radius or pl[a] - pr[b + len(y) - 1] > radius
            if skipped is not None:
                skipped.append(bool(far))
            if far:
                continue
            i, j = _near(x, y, radius)
            if within and a == b:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i + a, j + b


def _edges_of_unit(key: np.ndarray, f: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, root's key) edges of one unit: all against all, or side 1 against side 2."""
    order = np.lexsort((key, _pop(f), side))
    key, f, side = key[order], f[order], side[order]
    cut = int(np.searchsorted(side, 2))
    if cut == len(f):
        roots = _forest(len(f), tile_links(f, radius=radius))
    else:
        roots = _forest(len(f), ((i, j + cut) for i, j in tile_links(f[:cut], f[cut:], radius)))
    child = np.flatnonzero(roots != np.arange(len(f)))
    return key[child], key[roots[child]]


def _compare(batches, radius: int):
    """Rows (unit, side, key, f0..) sorted by unit to edges (a, b)."""
    held: list[np.ndarray] = []

    def settle(unit, side, key, f):
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(unit)]]))
        small = np.repeat(sizes, sizes) <= SMALL
        u, k, g = unit[small], key[small], f[small]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in range(1, SMALL):
            hit = (u[:-d] == u[d:]) & (_pop(g[:-d] ^ g[d:]) <= radius)
            a.append(k[:-d][hit])
            b.append(k[d:][hit])
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            x, y = _edges_of_unit(key[s : s + n], f[s : s + n], side[s : s + n], radius)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], names=["a", "b"])

    for batch in batches:
        unit, side, key, *f = (c.to_numpy() for c in batch.columns)
        cols = [unit, side, key, np.stack(f, axis=1).view(np.uint64)]
        if held:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last unit may go on
        if cut:
            yield settle(*(c[:cut] for c in cols))
        held = [c[cut:] for c in cols]
    if held and len(held[0]):
        yield settle(*held)


def _led(batches, radius: int, parts: int):
    """Rows (bucket, key, f0.., pop, leaders) to rows with ``cluster``, the key of the cluster of the first leader near, and ``near``, the keys of leaders to join.

    A leader is joined to all leaders near it, another row to the first.
    """
    names = ["bucket", "key", *_names(parts), "pop", "cluster", "near"]
    for batch in batches:
        bucket, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        f = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[2 : 2 + parts]], axis=1)
        lists = batch.column(batch.num_columns - 1)
        cluster, near = [None] * len(key), [[]] * len(key)
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            heads = lists[int(rows[0])].as_py()
            lead = np.array([h["key"] for h in heads], np.int64)
            g = np.array([[h[n] for n in _names(parts)] for h in heads], np.int64).view(np.uint64)
            roots = _forest(len(lead), [_near(g, g, radius)])
            close = np.zeros((len(rows), len(lead)), bool)
            close[_near(f[rows], g, radius)] = True
            heading = np.isin(key[rows], lead)
            for r, c, h in zip(rows, close, heading, strict=True):
                if c.any():
                    first = np.flatnonzero(c)
                    cluster[r] = int(lead[roots[first[0]]])
                    near[r] = [int(x) for x in lead[first if h else first[:1]] if x != key[r]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cluster, pa.int64()), pa.array(near, pa.list_(pa.int64()))], names=names)


def _little(df: DataFrame) -> DataFrame:
    """With a hint to broadcast, if the rows are few (counted)."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def links(nodes: DataFrame, tables: list[list[int]], radius: int = RADIUS, parts: int = 1, tile: int = TILE) -> DataFrame:
    """Edges (a, b), a > b, of keys, that join the fingerprints of ``nodes`` (key, f0..) as all links would that a table brings together."""
    names = _names(parts)
    kinds = ", ".join(f"{n} long" for n in ["key", *names])
    where = f"bucket long, {kinds}, pop short"
    spread = map_arrow(nodes.select("key", *names), lambda b: _in_tables(b, tables, parts), where)
    large = materialize(spread.groupBy("bucket").count().filter(F.col("count") > tile).select("bucket"), "large")
    edges = lambda df: map_arrow(df.repartition(width(nodes), "unit").sortWithinPartitions("unit"), lambda b: _compare(b, radius), "a long, b long").distinct()
    if large.isEmpty():
        return edges(spread.select(F.col("bucket").alias("unit"), F.lit(0).alias("side"), "key", *names))
    marked = spread.join(_little(large.withColumn("large", F.lit(True))), "bucket", "left")
    plain = marked.filter("large IS NULL").select(F.col("bucket").alias("unit"), F.lit(0).alias("side"), "key", *names)
    cut = marked.filter("large").select("bucket", "key", *names, "pop")
    first = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(SEED), "key"), "key")
    heads = cut.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= LEADERS)
    leaders = materialize(heads.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("n", "key", *names))).alias("leaders")), "leaders")
    led = materialize(map_arrow(cut.join(_little(leaders), "bucket").select("bucket", "key", *names, "pop", "leaders"), lambda b: _led(b, radius, parts), f"bucket long, {kinds}, pop short, cluster long, near array<long>"), "led")
    joined = led.select("key", F.explode("near").alias("near")).select(F.greatest("key", "near").alias("a"), F.least("key", "near").alias("b"))
    # tiles: a cluster's fingerprints (or those of none) whose counts lie in one step, salted if they are too many
    step = max(1, radius // 3)
    led = led.withColumn("pop", F.floor(F.col("pop") / step).cast("int"))
    group = ["bucket", "cluster", "pop"]
    tiles = materialize(led.groupBy(*group).count().withColumn("salts", F.ceil(F.col("count") / tile).cast("int")).drop("count"), "tiles")
    one, two = (tiles.select("bucket", F.col("cluster").alias(f"c{k}"), F.col("pop").alias(f"p{k}"), F.col("salts").alias(f"n{k}")) for k in "12")
    rank = lambda k: F.struct(F.coalesce(f"p{k}", F.lit(0)), F.col(f"c{k}").isNull(), F.col(f"c{k}"), F.col(f"s{k}"))
    # bound: for each bucket its clusters (LEADERS and none) times steps near each other, and the tiles that their rows fill
    pairs = (
        one.join(two, "bucket")
        .filter((F.abs(F.col("p2") - F.col("p1")) <= (radius - 1) // step + 1) & ~F.coalesce(F.col("c1") == F.col("c2"), F.lit(False)))
        .withColumn("s1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)))
        .withColumn("s2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
        .filter(rank("1") <= rank("2"))
        .withColumn("same", rank("1") == rank("2"))
        .withColumn("unit", F.xxhash64("bucket", F.coalesce("c1", F.lit(0)), F.col("c1").isNull(), "p1", "s1", F.coalesce("c2", F.lit(0)), F.col("c2").isNull(), "p2", "s2"))
    )
    end = lambda k, side: [F.col("bucket").alias("b"), F.col(f"c{k}").alias("c"), F.col(f"p{k}").alias("p"), F.col(f"s{k}").alias("s"), "unit", side.alias("side")]
    ends = pairs.select(*end("1", F.when(F.col("same"), 0).otherwise(1))).union(pairs.filter("NOT same").select(*end("2", F.lit(2))))
    salted = led.join(tiles.select(*(F.col(c).alias(f"t_{c}") for c in group), "salts"), F.expr("bucket = t_bucket AND cluster <=> t_cluster AND pop = t_pop")).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    crossed = salted.join(ends, F.expr("bucket = b AND cluster <=> c AND pop = p AND salt = s")).select("unit", "side", "key", *names)
    return edges(plain.union(crossed)).union(joined).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for each node that isn't that itself.  ``edges``: (a, b) with a > b."""
    edges = materialize(edges, "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = mark(edges)
    while was[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        large = materialize(large, "large-star")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).distinct()
        used, edges = edges, materialize(small, "small-star")
        discard(used)
        discard(large)
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _keyed(marked: DataFrame, parts: int) -> DataFrame:
    """``marked`` (f0..) with ``key``, a number for each distinct fingerprint: itself, if it has 64 bits, else a hash that keeps them apart."""
    names = _names(parts)
    if parts == 1:
        return marked.withColumn("key", F.col("f0"))
    distinct = materialize(marked.select(*names).distinct(), "distinct")
    for seed in itertools.count():
        key = F.xxhash64(F.lit(seed), *names)
        if distinct.groupBy(key.alias("key")).count().filter(F.col("count") > 1).isEmpty():
            discard(distinct)
            return marked.withColumn("key", key)


def _roots(marked: DataFrame, radius: int, parts: int, jaccard: float | None) -> DataFrame:
    """key, root (the smallest key of its component) and least (the smallest doc_id) for each distinct fingerprint of ``marked``."""
    names = _names(parts)
    nodes = materialize(marked.groupBy("key", *names).agg(F.min("doc_id").alias("least")), "nodes")
    n = nodes.count()
    tables = exact_tables(n, radius, parts) if jaccard is None else sampled_tables(n, jaccard, parts)
    found = components(links(nodes, tables, radius, parts))
    rooted = nodes.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    return materialize(rooted.select("key", "root", "least"), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id of its component, for every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = _keyed(materialize(fingerprints(slim, ["doc_id"], "text"), "simhash"), 1)
    ids = _roots(marked, RADIUS, 1, None)
    # only roots with several fingerprints need a second look; each fingerprint counts once, summed before the shuffle
    named = ids.join(ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    named = materialize(named, "components")
    return marked.join(named, "key").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Of a corpus cleaned of near copies: words of a shingle, similarity, numbers of a fingerprint.
FIVE, ALIKE, PARTS = 5, 0.8, 4


def radius_for(jaccard: float, parts: int, deviations: float = 1.6) -> int:
    """Bits in which sets of that similarity differ, and some standard deviations: 48 of 256 for 0.8, which 95 in 100 of such pairs keep."""
    n, p = 64 * parts, difference(jaccard)
    return math.ceil(n * p + deviations * math.sqrt(n * p * (1 - p)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = FIVE, jaccard: float = ALIKE, parts: int = PARTS) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id (null after all others), of rows with one id the first by the MD5 of its text.

    Texts link when their fingerprints of ``64 * parts`` bits do, at the radius of that Jaccard similarity of their shingles.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.col(text_col).cast("binary")).alias("digest"), F.col(text_col).alias("text"))
    marked = _keyed(materialize(fingerprints(keyed, ["doc_id", "digest"], "text", shingle, parts), "simhash"), parts)
    # a row is known by id and text: the same in both is the same fingerprint, so at most one component has it
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    roots = _roots(marked, radius_for(jaccard, parts), parts, jaccard)
    by = marked.groupBy("key").agg(F.min(rank).alias("first")).join(roots.select("key", "root"), "key").groupBy("root").agg(F.min("first").alias("first"))
    chosen = by.select(F.col("first.doc_id").alias("id"), F.col("first.digest").alias("hash"))
    alike = marked.groupBy("doc_id", "digest").agg((F.count("*") > 1).alias("alike"))
    kept = materialize(chosen.join(alike, F.expr("id <=> doc_id AND hash <=> digest")).select("id", "hash", "alike"), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("own"), F.md5(F.col(text_col).cast("binary")).alias("digest"))
    found = rows.join(kept, F.expr("own <=> id AND digest <=> hash"))
    single = found.filter("NOT alike").select("row.*")
    # rows alike in id and text: any one of them
    first = found.filter("alike").withColumn("n", F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(0)))).filter("n = 1")
    return single.unionByName(first.select("row.*"))
