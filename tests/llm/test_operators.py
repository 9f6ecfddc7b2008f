"""Operators of the subpackage against brute force, on small tables with awkward rows."""

import hashlib
import heapq
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import html_text, mixing, nbsvm, packing, pii, queries, sharding, simhash, syncmers, topk, toxicity
from spanloom.llm.common import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, size int, unit int, bucket int"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, 2, 3, 4) for i, t, s in rows], SCHEMA).repartition(3)


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, rng.randrange(1, 300)) for _ in range(60)]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    out += [(100 + i, base[0], "s0") for i in range(40)]  # exact copies, a third
    for i in range(20):  # near copies
        w = base[1].split() * 3
        w[rng.randrange(len(w))] = f"x{i}"
        out.append((200 + i, " ".join(w), "s1"))
    out += [(300, None, None), (301, "", "s0"), (302, " \n\t ", "s0"), (303, "one", "s2"), (304, "Ünï çödé – 漢字 😀 " * 30, "s2"), (305, words(rng, 60_000), "s2"), (7, base[7], "s1"), (7, base[7], "s1"), (None, "no id", "s1")]
    return out


def test_syncmers(spark, rows):
    rows = list({r[0]: r for r in rows if r[0] is not None}.values())
    got = {r["doc_id"]: r for r in syncmers.against_next(table(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        text, after = a[1] or "", b[1] or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + after[:cut]
        r = got[a[0]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == syncmers.fingerprint(text) and r["edited_fingerprint"] == syncmers.fingerprint(changed)
        assert r["near_next"] == syncmers.likeness(syncmers.fingerprint(text), syncmers.fingerprint(after))


def test_syncmers_of_repeated_ids_and_in_blocks(spark, monkeypatch):
    rng = random.Random(14)
    many = [(5, words(rng, 30), "s"), (5, words(rng, 30), "s"), (5, words(rng, 30), "s"), (9, words(rng, 30), "s"), (1, words(rng, 30), "s")]
    got = syncmers.against_next(table(spark, many)).collect()
    texts = {syncmers.fingerprint(t): t for _, t, _ in many}
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, syncmers.fingerprint(t)) for i, t, _ in many)
    follow = {hashlib.sha256(syncmers.edited(a, b).encode()).hexdigest(): (a, b) for a in texts.values() for b in texts.values()}
    chain = [follow[r["edited_sha256"]] for r in got]
    assert sorted(a for a, _ in chain) == sorted(b for _, b in chain) == sorted(texts.values())  # each is the next of one
    long = words(rng, 4000)
    whole = syncmers.anchors(long)
    monkeypatch.setattr(syncmers, "BLOCK", 1000)
    cut = syncmers.anchors(long)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_closed_syncmers_by_definition():
    text = words(random.Random(1), 50)
    k, s = syncmers.K, syncmers.S
    h, at = syncmers.anchors(text)
    x = syncmers._mix(syncmers.code_points(text).astype(np.uint64) + np.uint64(1))
    order = syncmers._mix(syncmers._doubled(x, s))
    want = [i for i in range(len(text) - k + 1) if min(order[i : i + k - s + 1]) in (order[i], order[i + k - s])]
    assert at.tolist() == want
    assert syncmers.anchors("zz" + text)[0][-5:].tolist() == h[-5:].tolist()  # free of context
    assert syncmers.matches(text, "zz" + text)[-1] == (int(at[-1]), int(at[-1]) + 2)


def test_syncmers_repeated_rows_nulls_and_empty(spark):
    odd = [(1, "a" * 90, "s"), (1, "a" * 90, "s"), (None, "b" * 50, "s"), (2, None, "s")]
    got = syncmers.against_next(table(spark, odd)).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 2, None: 1, 2: 1}
    assert syncmers.against_next(table(spark, odd[:1])).first()["near_next"] == 1.0
    assert syncmers.against_next(table(spark, []).filter("false")).count() == 0
    assert syncmers.with_anchors(table(spark, odd)).count() == 4


def test_packing(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(table(spark, rows), path, 2).collect()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = Counter()
    ids = {}
    for i, t, _ in rows:
        ids[i] = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] += len(ids[i])
    seqs = defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        want[r["doc_id"]] -= r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert not any(want.values())
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(table(spark, []).filter("false"), path, 2).count() == 0


def test_step_groups_are_even():
    out = []
    p = packing.Packer(lambda *x: out.append(x), 0)
    for i in range(400):
        p.add(i, 1 + (i * 397) % 6000)
    p.pack(last=True)
    tokens, tiers = Counter(), defaultdict(set)
    for _, _, length, _, _, size, step in out:
        tokens[step] += length
        tiers[step].add(size)
    assert max(tokens.values()) <= packing.STEP_TOKENS and all(len(x) == 1 for x in tiers.values())
    assert sum(v == packing.STEP_TOKENS for v in tokens.values()) >= len(tokens) - 14


def test_sharding(spark, rows):
    got = sharding.shard(table(spark, rows), 5).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    groups, shards, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t))
        groups[t].add(r["shard"])
        shards[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(x) == 1 for x in groups.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = Counter()
    for i, t, _ in rows:
        sizes[(t or "").encode()] += len((t or "").encode()) + 8
    heap = [0] * 5
    for n in sorted(sizes.values(), reverse=True):
        heapq.heappush(heap, heapq.heappop(heap) + n)
    assert sorted(shards.values()) == sorted(heap)
    assert sharding.shard(table(spark, []).filter("false"), 5).count() == 0


def naive_simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash(spark, rows):
    small = [r for r in rows if r[0] != 305]
    fps = [naive_simhash(t) for _, t, _ in small]
    want = Counter(zip([r[0] for r in small], [f"{f:016x}" for f in fps], naive_components([r[0] for r in small], fps), strict=True))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, small)).collect())
    assert got == want
    assert simhash.near_duplicates(table(spark, []).filter("false")).count() == 0


def test_one_of_each_keeps_one_row_of_every_component(spark):
    rng = random.Random(8)
    a, b, c, d, e, f = (words(rng, 80) for _ in range(6))
    odd = [(None, a, "s"), (None, b, "s"), (None, b, "s"), (None, None, "s"), (5, c, "s"), (5, d, "s"), (6, d, "s"), (7, e, "s"), (7, e, "s"), (None, e, "s"), (9, f, "s"), (8, f, "s")]
    got = Counter((r["doc_id"], r["text"]) for r in simhash.one_of_each(table(spark, odd)).collect())
    assert got == Counter([(None, a), (None, b), (None, None), (5, c), (5, d), (7, e), (8, f)])


def test_simhash_large_buckets(spark, monkeypatch):
    rng = random.Random(5)
    fps = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.append(centre ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(5))))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "key long, f0 long")
    want = naive_components(signed, fps)
    for unit, leaders in ((16, 16), (16, 2), (1 << 20, 4)):  # many buckets, most of them large; one bucket
        monkeypatch.setattr(simhash, "LEADERS", leaders)
        edges = simhash.links(nodes, simhash.exact_tables(len(fps), 3, unit=unit), tile=16)
        found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        assert [found.get(f, f) for f in signed] == want


def test_tiles_too_far_apart_are_skipped():
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 63, 3000, np.uint64))[:, None]
    fps = fps[np.argsort(np.bitwise_count(fps[:, 0]))]
    skipped = []
    got = {(int(i), int(j)) for x, y in simhash.tile_links(fps, radius=15, side=64, skipped=skipped) for i, j in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:, 0] ^ fps[i, 0]) <= 15).tolist() if i < j}
    assert got == want and len(want) > 20
    skipped = []
    list(simhash.tile_links(fps, radius=3, side=64, skipped=skipped))
    assert 0.3 < sum(skipped) / len(skipped) < 1


def test_near_copies_of_five_word_shingles(spark):
    """Of pairs with a Jaccard similarity of 0.8 or more nearly all link, of those under 0.5 none."""
    rng = random.Random(12)
    out, alike = [], []
    for i in range(400):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        v = list(w)
        for _ in range(rng.randrange(1, 12)):
            v[rng.randrange(len(v))] = f"x{rng.randrange(5000)}"
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, v))
        alike.append(len(a & b) / len(a | b))
        out += [(i, " ".join(w), "s"), (1000 + i, " ".join(v), "s")]
    kept = {r[0] for r in simhash.one_of_each(table(spark, out)).select("doc_id").collect()}
    gone = [1000 + i not in kept for i in range(400)]
    assert all(i in kept for i in range(400))
    near = [g for g, j in zip(gone, alike, strict=True) if j >= 0.8]
    assert len(near) > 100 and sum(near) / len(near) > 0.95
    assert not any(g for g, j in zip(gone, alike, strict=True) if j < 0.5)


def test_sampled_tables_meet_their_share():
    rng = np.random.default_rng(9)
    tables = simhash.sampled_tables(1 << 22, 0.8, 4)
    differ = rng.random((4000, 256)) < simhash.difference(0.8)
    met = np.zeros(4000, bool)
    for bits in tables:
        met |= ~differ[:, bits].any(1)
    assert met.mean() > 0.98


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 8).round(2).tolist()) for i in range(1, 700)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    rows += [(2000, None), (2001, [None] * 8), (2100, [float("nan")] * 8), (2200, [1.0, 2.0]), (2300, [0.0] * 8), (2400, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in topk.top_k(df, 10, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    v = {i: np.floor(1024 * np.array(x, float)).astype(np.int64) for i, x in rows if x and all(y is not None and np.isfinite(y) for y in x)}
    for q in [i for i in v if i % 100 == 0 and i != 2200]:
        best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:10]
        assert got.pop(q) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert not got
    assert topk.top_k(df.filter("false"), 10, F.lit(True)).count() == 0
    # repeated query rows ask once; as candidates they are two rows
    v[200] = v[1] * 3  # among the best of 100
    many = spark.createDataFrame([(i, x.tolist()) for i, x in v.items() if len(x) == 8 for _ in range(2 if i in (100, 200) else 1)], "vec_id long, v array<long>").selectExpr("vec_id", "transform(v, x -> x / 1024D) AS embedding")
    best = sorted((-int(v[100] @ x), i) for i, x in v.items() if i != 100 and len(x) == 8 for _ in range(2 if i == 200 else 1))[:10]
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(many, 10, F.col("vec_id") == 100).orderBy("rank").collect()] == [(i, -x) for x, i in best]


def test_threshold_algorithm_stops_early():
    x = np.zeros((5000, 4), np.int64)
    x[:, 0] = np.arange(5000)
    lists = topk.SortedLists(np.arange(5000), x)
    ids, best, seen = lists.top(-1, np.array([1, 0, 0, 0]), 3)
    assert ids.tolist() == [4999, 4998, 4997] and best.tolist() == [4999, 4998, 4997] and seen < 0.01


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def naive_pii(text):
    out = {}
    for kind, p in BASE.items():
        out[kind] = []
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out


def test_plain_pii_equals_patterns():
    rng = random.Random(9)
    alphabet = ["@", ".", "-", " ", "+", "(", ")", "1", "23", "255", "4539578763621486", "a", "b.c", "x@y.zz", "300", "é", "1.2.3.4", "\n", "%"]
    for _ in range(6000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 24)))
        assert pii.plain(t) == naive_pii(t), t


def found(text):
    return {k: [text[a:b] for a, b in v] for k, v in pii.spans(text)[1].items() if v}


def test_disguised_pii():
    assert found("write to jane.doe (at) example [dot] org now") == {"email": ["jane.doe (at) example [dot] org"]}
    assert found("write to jane at example dot org now") == {"email": ["jane at example dot org"]}
    assert found("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ") == {"email": ["ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"]}
    assert found("pаul@exаmple.com")["email"] == ["pаul@exаmple.com"]  # Cyrillic а
    assert found("call plus four nine three zero one two three four five six today") == {"phone": ["plus four nine three zero one two three four five six"]}
    assert found("host one two seven dot zero dot zero dot one up") == {"ip": ["one two seven dot zero dot zero dot one"]}
    for clean in ("look at this. One two and three dots", "she sat at home at two", "le point au point", "", "a b at c. d"):
        assert found(clean) == {}


def test_every_listed_disguise_is_looked_for():
    assert all(pii.ODD.fullmatch(c) for c in [*pii.HOMOGLYPHS, *pii.INVISIBLE] if not c.isascii())
    for space in "\u00a0\u2002\u2003\u2007\u2009\u202f":
        assert found(f"+49{space}30{space}1234567") == {"phone": [f"+49{space}30{space}1234567"]}
    assert found("jo@example\u00b7org") == {"email": ["jo@example\u00b7org"]}
    for other in ("", " one two three four", " \uff21"):
        assert found("jo@example dot org" + other) == {"email": ["jo@example dot org"]}


def test_disguises_beside_words_and_separators():
    number = "plus four nine three zero one two three four five six"
    for after in (" until noon", " undone", " oneself", " dots"):
        assert found(f"call {number}{after}") == {"phone": [number]}
    for address in ("jo-at-example-dot-org", "jo_at_example_dot_org", "jo at my-site dot org", "jo (at) my-site dot org", "jo-ann at my-site dot example dot org", "jo dot doe at example dot org", "jo-at-work at example dot org", "jo (at) example_dot_org"):
        assert found(f"write to {address}, now") == {"email": [address]}
    for clean in ("a state-of-the-art thing", "look-at-me now", "one-at-a-time dots"):
        assert found(clean) == {}
    started = time.perf_counter()
    for piece in ("a-", "a_at_", "a dot ", "a.", "one ", "a at b ", "@a dot "):
        pii.spans(piece * 40_000 + "dot")
    assert time.perf_counter() - started < 30


def test_pii_tables(spark, rows):
    rows = [*rows, (400, "a@b.co 1.2.3.4 +1 (555) 555-0000", "s0")]
    got = pii.find(table(spark, rows))
    assert got.count() == len(rows)
    r = got.filter("doc_id = 400").first()
    assert (r["n_email"], r["n_ip"], r["n_phone"], r["spans"]) == (1, 1, 1, "email:0:6,ip:7:14,phone:15:32")
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    masked = pii.redact(table(spark, rows))
    assert masked.columns == table(spark, rows).columns and masked.filter("doc_id = 400").first()["text"] == "<email> <ip> <phone>"
    assert masked.filter("text IS NULL").count() == 1
    assert pii.find(table(spark, []).filter("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; more</h1><p>First   <b>bold</b>
 line<br><p>Second&nbsp;one &lt;x&gt;</p><form><input><label>Mail</label></form><aside>See also</aside>
<section class="comments"><p>nice post</p></section></article><footer>&copy; me</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Head & more\nFirst bold line\nSecond one <x>"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("just text") == "just text"
    bare = "<div><a href=1>a</a> <a href=2>b</a></div>" * 4 + "<p>" + "long text " * 30 + "</p><p>" + "more text " * 30 + "</p>" + "<div><a href=1>c</a></div>" * 4
    assert html_text.main_text(bare).count("\n") <= 3 and "long text" in html_text.main_text(bare) and "more text" in html_text.main_text(bare)
    assert html_text.main_text("<nav>menu<article><p>open menu</p></article>") == "open menu"


def test_html_ratios_decide_beside_an_article():
    body = "<div>" + "".join(f"<p>Paragraph {i} " + "of the body of this page, with many words in it. " * 3 + "</p>" for i in range(6)) + "</div>"
    cards = "".join(f"<article><h3><a href=/{i}>Card {i}</a></h3><p>A short card {i}</p></article>" for i in range(5))
    links = "".join(f"<div><a href=/{i}><b>l{i}</b></a></div>" for i in range(12))
    for page in (cards + body, body + cards):
        assert html_text.main_text(f"<body>{links}{page}{links}").count("Paragraph") == 6
    assert "l3" not in html_text.main_text(f"<body>{links}{cards}{body}{links}")


def test_html_alike_lines_are_not_split():
    page = "".join("<p>" + "x" * 100 + "</p>" for _ in range(20)) + "<p>" + "y z " * 5000 + "</p>"
    assert html_text.main_text(page).count("\n") == 20


def test_html_topics_and_short_lines_stay():
    text = "Some words of a real section of the article. " * 4
    assert html_text.main_text(f"<article>{f'<p>{text}</p>' * 5}<p>Is so.</p><p>In.</p></article>").endswith("Is so.\nIn.")
    page = f'<article><h1>T</h1><p>Yes.</p><p>{text}</p><section id="discussion"><h2 id="related-work">Related</h2><p>{text}</p></section><p>No.</p><div class="legal"><p>{text}</p></div><div class="share-buttons"><p>{text}</p></div><div class="comment-list"><p>{text}</p></div></article>'
    assert html_text.main_text(page).split("\n") == ["T", "Yes.", text.strip(), "Related", text.strip(), "No.", text.strip()]


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (None, "u", "", 5), (1, "u", PAGE, 5)], "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 42), (1, 42), (2, 0)]


def exponent(tokens, *limits):
    return mixing.exponent_for(mixing.moments_of(tokens), len(tokens), min(tokens), max(tokens), *limits)


def naive_entropy(tokens, x):
    return -sum(w * np.log(w) for w in mixing.weights_of(tokens, x))


def test_mixing_exponent():
    t = [1000.0, 100.0, 10.0]
    target = naive_entropy(t, 1) + 0.7 * (np.log(3) - naive_entropy(t, 1))
    x = exponent(t, 0.7, 1e9)
    assert 0 < x < 1 and abs(naive_entropy(t, x) - target) < 1e-9
    assert abs(mixing.entropy(mixing.moments_of(t), x) - target) < 1e-9
    y = exponent(t, 0.7, 3.0)
    w = mixing.weights_of(t, y)
    passes = [a / b for a, b in zip(w, t, strict=True)]
    assert y > x and abs(max(passes) / min(passes) - 3.0) < 1e-6
    assert exponent([5.0], 0.9, 2.0) == 1.0 and exponent([5.0, 5.0], 0.9, 2.0) == 1.0 and exponent(t, 0.0, 9.0) == 1.0


def test_the_query_s_own_limits_act(spark):
    """On the query's table the bisection ends below 1, and some documents come twice."""
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "source", mixing.count_tokens("text").alias("n_tokens"))
    plans, _, x = mixing.plan(docs, **queries.MIXTURE)
    sizes = [r["tokens"] for r in plans.collect()]
    assert 0 < x < 1 and abs(x - exponent(sizes, *queries.MIXTURE.values())) < 1e-9
    got = queries.op3_mixture(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in docs.collect()} and max(r["pass"] for r in got) == 1


def naive_mixture(rows, evenness, most_passes, block_tokens, seed, hashes):
    """Brute force on the driver; ``hashes`` gives XXH64 as Spark has it."""
    sources = sorted({s for _, s, _ in rows}, key=str)
    tokens = [sum(n for _, s, n in rows if s == x) for x in sources]
    x = exponent(tokens, evenness, most_passes)
    weights = mixing.weights_of(tokens, x)
    whole = max(tokens) / weights[tokens.index(max(tokens))]
    out = {}
    for s, t, w in zip(sources, tokens, weights, strict=True):
        budget, blocks = max(t, round(w * whole)), -(-t // block_tokens)
        for p in range(-(-budget // t)):
            mine = [(i, n, hashes[i, p][0] % blocks) for i, z, n in rows if z == s]
            order = sorted({b for _, _, b in mine}, key=lambda b: (hashes[b, p, "block"], b))
            at = p * t
            for b in order:
                for i, n, _ in sorted((m for m in mine if m[2] == b), key=lambda m: (hashes[m[0], p][1], m[0])):
                    if at < budget:
                        out[i, p] = (b, at / budget)
                    at += n
    return out


def test_mixing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "a" if i < 300 else "b" if i < 400 else None, rng.randrange(1, 60)) for i in range(500)]
    df = spark.createDataFrame([(*r, "x", 0.5, 7) for r in rows], "doc_id long, source string, n_tokens long, row string, weight double, src int").repartition(4)
    hashes = {}
    seeds = spark.createDataFrame([(i, p) for i in range(500) for p in range(3)], "doc_id long, p int").select("doc_id", "p", F.xxhash64(F.lit(17), F.struct("doc_id")).alias("a"), F.xxhash64(F.lit(17), "p", F.struct("doc_id")).alias("b"), F.xxhash64(F.lit(17), "p", F.col("doc_id").cast("int")).alias("c"))
    for r in seeds.collect():
        hashes[r["doc_id"], r["p"]] = (r["a"], r["b"])
        hashes[r["doc_id"], r["p"], "block"] = r["c"]
    want = naive_mixture(rows, 0.8, 2.5, 500, 17, hashes)
    for few in (100_000, 1):  # weights from the driver, from Spark
        monkeypatch.setattr(mixing, "FEW_SOURCES", few)
        got = mixing.mix(df, 0.8, 2.5, block_tokens=500)
        assert got.columns == ["doc_id", "source", "n_tokens", "row", "src", "pass", "block", "at", "weight"]
        got = got.collect()
        assert {(r["doc_id"], r["pass"]): (r["block"], r["at"]) for r in got} == want and len(got) == len(want) > 500
    for s in ("a", "b", None):
        at = sorted((r["at"], r["n_tokens"]) for r in got if r["source"] == s)
        assert abs(sum(n for a, n in at if a < 0.5) / sum(n for _, n in at) - 0.5) < 0.05
    assert mixing.mix(df.filter("false"), 0.9, 2.0).count() == 0
    twice = df.filter("doc_id < 5").union(df.filter("doc_id < 5"))
    assert mixing.mix(twice, 0.5, 2.0).count() == 10


def labelled(spark, bad):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        y = int(i % 4 == 0)
        w = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lnrst')}" for _ in range(rng.randrange(30, 90))]
        if y:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "s"))
        if i % 3:
            labels.append((i, 1 - y, y))
    rows += [(2000, None, "s"), (2001, "", "s"), (2002, "x", "s")]
    return table(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")


def accuracy(got, label):
    rows = [r for r in got.collect() if r["held_out"] and r["doc_id"] < 900]
    return np.mean([r["predicted"] == label(r["doc_id"] % 4 == 0) for r in rows])


def test_toxicity(spark):
    docs, labels = labelled(spark, ["wretchedfool", "vilebeast", "horridcreep"])
    got = toxicity.scores(docs, toxicity.fit(docs, labels)).cache()
    assert got.count() == docs.count() and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert accuracy(got, int) > 0.93
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert set(none) == {"constant"}


def test_quality(spark):
    docs, labels = labelled(spark, ["$$$!!!", "&&&%%%", "BUY!!NOW"])
    model = nbsvm.fit(docs, labels)
    got = nbsvm.scores(docs, model).cache()
    assert got.count() == docs.count() and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert accuracy(got, lambda bad: int(not bad)) > 0.95
    assert nbsvm.keep(docs, model).count() == got.filter("predicted = 1").count()
    assert set(nbsvm.fit(docs, labels.filter("false"))) == {"constant"}


def test_scores_do_not_read_labels_of_held_out_rows(spark):
    docs, labels = labelled(spark, ["$$$!!!", "&&&%%%"])
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (nbsvm.fit(docs, x) for x in (labels, flipped))
    assert a["bias"] == b["bias"] and (a["weights"] == b["weights"]).all()
