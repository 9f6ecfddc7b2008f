"""Page content, toxicity, quality and personal data against plain versions of their parts, and hostile inputs."""

import math
import random
import time

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import html_text, nbsvm, pii, toxicity


def naive_content(lines):
    """Lines [text, tags, in an article, heading] kept, by the rule of the module, without arrays."""
    raw = [math.log(1 + min(len(t) / max(1, n), html_text.FULL)) + html_text.BONUS * a for t, n, a, _ in lines]
    smooth = []
    for i in range(len(raw)):
        near = [(math.exp(-0.5 * ((j - i) / html_text.SIGMA) ** 2), raw[j]) for j in range(max(0, i - html_text.REACH), min(len(raw), i + html_text.REACH + 1))]
        smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    low, high = min(smooth), max(smooth)
    if high - low >= html_text.APART:
        for _ in range(50):
            cut = (low + high) / 2
            a, b = [x for x in smooth if x < cut], [x for x in smooth if x >= cut]
            new = sum(a) / len(a), sum(b) / len(b)
            if max(abs(new[0] - low), abs(new[1] - high)) < 1e-12:
                break
            low, high = new
    cut = (low + high) / 2 if high - low >= html_text.APART else min(smooth)
    keeps = [x >= cut - 1e-12 for x in smooth]
    # between content, or after a heading, short runs stay
    anchors = [i for i in range(len(lines)) if keeps[i] or lines[i][3]]
    for k in range(len(anchors) - 2, -1, -1):
        i, j = anchors[k], anchors[k + 1]
        if keeps[j] and j - i - 1 <= html_text.BETWEEN:
            for x in range(i, j):
                keeps[x] = True
    i = 0
    while i < len(lines):
        if keeps[i]:
            i += 1
            continue
        j = i
        while j < len(lines) and not keeps[j]:
            j += 1
        beside = (i > 0 and lines[i - 1][2]) or (j < len(lines) and lines[j][2])
        if j - i <= html_text.BETWEEN and beside and all(lines[x][2] for x in range(i, j)):
            for x in range(i, j):
                keeps[x] = True
        i = j
    return keeps


def test_content_is_that_of_the_plain_rule():
    rng = random.Random(3)
    for _ in range(400):
        lines = []
        while len(lines) < rng.randrange(1, 40):
            long = rng.random() < 0.5
            for _ in range(rng.randrange(1, 6)):
                lines.append(["x" * (rng.randrange(60, 400) if long else rng.randrange(1, 20)), rng.randrange(1, 3) if long else rng.randrange(1, 9), rng.random() < 0.3, rng.random() < 0.1])
        assert html_text.content(lines).tolist() == naive_content(lines)


def page(rng):
    """A page whose article is known."""
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    body = [words(rng.randrange(25, 90)) for _ in range(rng.randrange(4, 12))]
    links = lambda n: "".join(f'<li><a href="/{i}">{words(2)}</a></li>' for i in range(n))
    article = "".join(f"<p>{p[: len(p) // 2]}<b>{p[len(p) // 2 :]}</b></p>\n" for p in body)
    marked = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>"])
    return f"<html><head><title>t</title><style>p {{}}</style></head><body><nav><ul>{links(8)}</ul></nav><div class='cookie-banner'><p>{words(30)}</p></div>{marked.format(article)}<aside><p>{words(40)}</p></aside><section class='comments'><p>{words(60)}</p></section><script>var a = '<p>{words(9)}</p>';</script><footer><p>{words(20)}</p></footer></body></html>", "\n".join(body)


def test_pages_with_a_known_article():
    rng = random.Random(4)
    for _ in range(200):
        html, text = page(rng)
        assert html_text.main_text(html) == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<>/&;\"'=! apdivbrtscx-\n"), max_size=200))
def test_any_markup_has_a_text(html):
    got = html_text.main_text(html)
    assert got == "\n".join(" ".join(x.split()) for x in got.split("\n"))


def test_what_is_dropped_inside_a_line():
    text = "Some words of an article. " * 4
    assert html_text.main_text(f"<p>{text}<script>var x = '<p>1</p>';</script>and <button><div>press</div></button>more {text}</p>") == f"{text}and more {text}".strip()


@pytest.mark.parametrize("html", ["<div>" * 20000 + "</span>" * 20000, "<div><article>" + "<b>" * 20000 + "</div>" * 20000, "<a " * 50000, "<" * 200000, "<a b=\"" * 50000 + ">", "<!--" * 50000, "<h1>" * 5000 + "<p>x" * 20000, "<p>word</p>" * 30000])
def test_hostile_pages_take_linear_time(html):
    start = time.process_time()
    html_text.main_text(html)
    assert time.process_time() - start < 10


def test_empty_page_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("text", ["one " * 20000 + "onex", "dot " + "a-" * 20000, "dot " + "a_" * 20000, "@" + "a dot " * 10000, "one," * 20000, "1 " * 40000, "+1" * 20000, "1." * 40000, "[ " * 20000])
def test_hostile_texts_take_linear_time(text):
    start = time.process_time()
    pii.spans(text)
    assert time.process_time() - start < 10


DISGUISED = [
    ("email", "jo.bloggs (at) example (dot) org", "write to {}, please"),
    ("email", "jo at my-site dot org", "or {} today"),
    ("email", "jо@exаmple.org", "cyrillic {} letters"),
    ("phone", "plus four nine three zero one two three four five six", "call {}, oneself"),
    ("phone", "+４９ 30 1234567", "wide {} digits"),
    ("ip", "192[.]168[.]0[.]7", "host {} is down"),
    ("card", "4111​ 1111 1111 1111", "paid by {} once"),
]


def test_disguises_planted_in_a_table(spark):
    """Each planted span comes back at its source offsets, and clean rows add none."""
    rng = random.Random(7)
    filler = lambda n: " ".join(rng.choice(["the", "sum", "of", "at", "dot", "plus", "one", "house"]) for _ in range(n))
    rows, want = [], {}
    for i in range(210):
        kind, hidden, around = DISGUISED[i % len(DISGUISED)]
        before = filler(rng.randrange(0, 40)) + ". " + around.split("{}")[0]
        rows.append((i, before + hidden + around.split("{}")[1] + ". " + filler(20)))
        want[i] = (kind, len(before), len(before) + len(hidden))
    rows += [(1000 + i, filler(60).replace("dot", "door").replace("one", "only")) for i in range(50)] + [(2000, None), (2001, "")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, (kind, a, b) in want.items():
        assert f"{kind}:{a}:{b}" in got[i]["spans"].split(","), (rows[i], got[i]["spans"])
        assert got[i]["n_added"] >= 1
    assert all(got[i]["spans"] == "" for i in got if i >= 1000)


def table(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, y int, score double").repartition(2)


def test_features_of_quality_by_definition():
    rng = random.Random(5)
    f = nbsvm.Features()
    for _ in range(50):
        text = "".join(rng.choice("abé 漢\n") for _ in range(rng.randrange(0, 60)))
        data = text.encode()
        want = set()
        for n in nbsvm.GRAMS:
            for i in range(len(data) - n + 1):
                want.add((((int.from_bytes(data[i : i + n], "big") + n) & 0xFFFFFFFF) * 2654435769 & 0xFFFFFFFF) >> (32 - nbsvm.BITS))
        assert f.of(text).tolist() == sorted(want)
    long = "".join(rng.choice("abcdefgh ") for _ in range(nbsvm.CHUNK + 1000))
    whole = f.of(long)
    assert set(f.of(long[-2000:]).tolist()) <= set(whole.tolist())


def test_ratios_and_the_dual_optimum():
    """Ratios by counting; coordinate descent closes the gap between primal and dual."""
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 40 if i % 2 else 60, 12)).astype(np.int32) for i in range(80)]
    y = np.array([i % 2 for i in range(80)])
    r = nbsvm.log_ratios(rows, y)
    counts = [[nbsvm.ALPHA] * (1 << nbsvm.BITS) for _ in (0, 1)]
    for x, c in zip(rows, y, strict=True):
        for j in x:
            counts[c][j] += 1
    totals = [sum(c) for c in counts]
    for j in range(70):
        assert abs(r[j] - (math.log(counts[1][j] / totals[1]) - math.log(counts[0][j] / totals[0]))) < 1e-12
    cost = np.where(y > 0, 1.0, 0.5)
    w, bias = nbsvm.hinge(rows, y, r, cost, passes=2000)
    s = np.where(y > 0, 1.0, -1.0)
    values = [r[x] / np.sqrt((r[x] ** 2).sum()) for x in rows]

    def primal(w, bias):
        return 0.5 * (w @ w + bias * bias) + sum(c * max(0.0, 1 - t * (w[x] @ v + bias)) for x, v, t, c in zip(rows, values, s, cost, strict=True))

    best = primal(w, bias)
    for _ in range(200):  # no direction leads down
        step = rng.normal(0, 0.02, 60)
        other = w.copy()
        other[:60] += step
        assert primal(other, bias + rng.normal(0, 0.02)) >= best - 1e-3
    slow = np.zeros(len(r)), 0.0
    for k in range(4000):  # subgradient descent as a second solver
        g, gb = slow[0].copy(), slow[1]
        for x, v, t, c in zip(rows, values, s, cost, strict=True):
            if t * (slow[0][x] @ v + slow[1]) < 1:
                g[x] -= c * t * v
                gb -= c * t
        slow = slow[0] - g / (k + 20), slow[1] - gb / (k + 20)
    assert best <= primal(*slow) + 1e-6 and primal(*slow) - best < 0.05 * best


def test_gains_by_definition():
    """Features from lengths that two plain compressors give, window by window."""
    toxic, ordinary = b" horridcreep vilebeast wretchedfool " * 3, b" the house of the old man and his garden was green " * 20
    d = toxicity.Distance(toxic, ordinary)
    rng = random.Random(8)
    for _ in range(40):
        text = " ".join(rng.choice(["the", "house", "vilebeast", "garden", "x" * 3000, "horridcreep"]) for _ in range(rng.randrange(0, 60)))
        gains = []
        for w in toxicity.windows(text):
            size = []
            for content in (ordinary, toxic + ordinary):
                how = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=1024, dict_size=len(content), min_match=toxicity.MATCH, window_log=toxicity.LOG, hash_log=toxicity.LOG, chain_log=toxicity.LOG, write_content_size=False, write_checksum=False, write_dict_id=False)
                c = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                c.precompute_compress(compression_params=how)
                size.append(len(zstandard.ZstdCompressor(dict_data=c, compression_params=how).compress(w)))
            gains.append(size[0] - size[1])
        strong = [g for g in gains if g >= toxicity.STRONG]
        want = (min(max(gains), toxicity.TOP), min(np.mean(sorted(gains)[-2:]), toxicity.TOP), np.clip(np.mean(gains), -5, 10), len(strong) / math.sqrt(len(gains)), math.log1p(sum(strong)), math.log1p(len(gains)))
        assert np.allclose(d.features(text), want)
    assert b" ".join(w.strip() for w in toxicity.windows("A b  c\n" * 30)) == b" ".join([b"a b c"] * 30)
    assert max(map(len, toxicity.windows("y" * 50_000))) <= toxicity.WINDOW * (toxicity.WORD_BYTES + 1) + 2


def samples(n=240):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(40)]
        if i % 3 == 0:
            w[3] = w[20] = rng.choice(["vilebeast", "horridcreep"])
        rows.append((i, " ".join(w), 1, 0.5))
        labels.append((i, int(i % 3 != 0), int(i % 3 == 0)))
    return rows, labels


@pytest.mark.parametrize("module", [toxicity, nbsvm])
def test_awkward_tables_of_labelled_rows(spark, module):
    """Empty table, repeated rows and ids, nulls, a very long text; a fit that is run again gives the same scores."""
    rows, labels = samples()
    odd = [(5, rows[5][1], 1, 0.5), (6, "another text of that id", 1, 0.5), (None, None, None, None), (900, "word " * 60_000, 1, 0.1), (901, "z" * 300_000, 1, 0.1), (902, "", 1, 0.1)]
    docs = table(spark, rows + odd)
    marks = spark.createDataFrame([*labels, (900, 1, 0), (5, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    score = lambda d: sorted((r["doc_id"] or -1, r["score"], r["predicted"], r["held_out"]) for r in module.scores(d, module.fit(d, marks)).collect())
    got = score(docs)
    assert len(got) == len(rows) + len(odd) and all(0 <= r[1] <= 1 for r in got)
    assert got == score(table(spark, list(reversed(rows + odd))))
    empty = docs.filter("false")
    assert module.scores(empty, module.fit(empty, marks)).count() == 0
    assert set(module.fit(docs, marks.filter("false"))) == {"constant"}
    if module is nbsvm:
        assert nbsvm.keep(docs, {"constant": 0.1}).count() == docs.count()
        assert nbsvm.keep(docs, nbsvm.fit(docs, marks)).columns == docs.columns


def test_fit_is_bounded_in_bytes(spark, monkeypatch):
    rows, labels = samples(60)
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from spanloom.llm import labelled

    chosen, _ = labelled.sample(marks, "quality", {0: 100, 1: 100}, 3, 1)
    total = sum(len(t) for i, t, *_ in rows if i in {r[0] for r in chosen.collect()})
    few, _ = labelled.texts(docs, chosen, 10_000, total // 2)
    kept = few.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    assert 0 < kept[0] <= total // 2
    assert labelled.texts(docs, chosen, 10, total)[0].count() == 0
