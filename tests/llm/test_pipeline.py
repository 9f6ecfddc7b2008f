"""The corpus pipeline, stage by stage, against plain versions, on a small corpus with awkward rows and clashing columns."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import nbsvm, pii, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, row int, key int, f0 int, digest string, __id int, pass int, weight double, label int"


def words(rng, n):
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []

    def add(i, text, source):
        rows.append((i, text, "en", source, None if text is None else len(text), 1, 2, 3, "d", 4, 5, 0.5, 6))

    for i in range(300):
        good = i % 3 != 0
        text = words(rng, rng.randrange(30, 120))
        add(i, text if good else "".join(c + rng.choice("$%&#") if c == " " else c for c in text), f"s{min(4, int(rng.expovariate(0.9)))}")
        labels.append((i, int(good), 0))
    base = [r for r in rows if r[0] % 3 != 0][:12]
    for k, r in enumerate(base):  # exact copies, and near copies with one word changed
        add(1000 + k, r[1], "s0")
        w = r[1].split()
        w[len(w) // 2] = "changed"
        add(2000 + k, " ".join(w), "s1")
    add(3000, words(rng, 50) + " mail jo@example.org or +49 30 1234567 now " + words(rng, 50), "s0")
    add(None, words(rng, 60), None)
    add(None, words(rng, 60), "s0")
    add(7, words(rng, 40), "s2")  # an id that is there already
    rows.append(rows[4])
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def near(texts):
    """Components of all pairs of fingerprints within the radius."""
    f = np.array([simhash.fingerprint(t or "", simhash.FIVE, simhash.PARTS) for t in texts])
    radius, root = simhash.radius_for(simhash.ALIKE, simhash.PARTS), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if np.bitwise_count(f[i] ^ f[j]).sum() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_stages(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)

    model = nbsvm.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    good = stages["quality"](spark, docs, path)
    scored = Counter((r["doc_id"], r["predicted"]) for r in nbsvm.scores(docs, model).collect())
    assert good.columns == docs.columns
    assert Counter(r[0] for r in good.collect()) == Counter({i: n for (i, p), n in scored.items() if p})
    kept = {r[0] for r in good.collect()}
    assert sum(i % 3 != 0 and i in kept for i in range(300)) > 180 and sum(i % 3 == 0 and i in kept for i in range(300)) < 10

    # each of the next stages works on all its predecessor kept
    rows = [tuple(r) for r in good.collect()]
    single = stages["near_duplicates"](spark, good, path)
    groups = defaultdict(list)
    for r, g in zip(rows, near([r[1] for r in rows]), strict=True):
        groups[g].append(r)
    first = lambda rs: min(rs, key=lambda r: (r[0] is None, r[0] or 0))[0]
    got = order(single)
    assert Counter(r[0] for r in got) == Counter(first(rs) for rs in groups.values())
    assert not [r for r in got if r[0] is not None and r[0] >= 1000 and r[0] < 3000 and r[0] % 1000 < 12]

    masked = stages["personal_data"](spark, single, path)
    assert masked.columns == docs.columns
    assert order(masked) == sorted(((r[0], None if r[1] is None else pii.masked(r[1]), *r[2:4], None if r[1] is None else len(pii.masked(r[1])), *r[5:]) for r in got), key=str)
    assert any("<email>" in (r[1] or "") and "<phone>" in r[1] for r in order(masked) if r[0] == 3000)

    mixed = stages["mixture"](spark, masked, path)
    assert mixed.columns == docs.columns
    times = Counter(tuple(r) for r in mixed.collect())
    assert set(times) == {tuple(r) for r in masked.collect()} and set(times.values()) == {1, 2}
    share = lambda c: {s: sum(n * len((r[1] or "").split()) for r, n in c.items() if r[3] == s) / sum(n * len((r[1] or "").split()) for r, n in c.items()) for s in {r[3] for r in c}}
    was, now = share(Counter(tuple(r) for r in masked.collect())), share(times)
    assert now[min(was, key=was.get)] > was[min(was, key=was.get)] and now[max(was, key=was.get)] < was[max(was, key=was.get)]

    packed = stages["pack"](spark, mixed, path).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    assert len(before) > len(rows) > len(got)


def test_run_and_empty_table(spark, corpus, tmp_path):
    path, _ = corpus
    got = corpus_pipeline.run(spark, path)
    assert got.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs.filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").filter("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_without_labels_nothing_is_rejected(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert nbsvm.keep(docs, nbsvm.fit(docs, spark.read.parquet(f"{path}/labels.parquet").filter(F.lit(False)))).count() == len(rows)
