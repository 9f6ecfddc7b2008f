"""Registered queries and their operators: nothing that grows with the input is gathered, and results are those of the long forms."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import arrays, text
from spanloom.operators import block_data, metrics, retrieval, spans
from spanloom.plans import registry
from spanloom.plans import labels as L

SPAN = "struct<sl:int,sc:int,el:int,ec:int>"


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, tmp_path, texts):
    return table(spark, tmp_path, "documents", [(i, t, "en", f"src{i}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_labels_of_arrays_are_those_of_rows(spark, tmp_path):
    rng = random.Random(21)
    texts = ["\n".join(" ".join(rng.choice(["", "a", "éa", "word", "𝄞x", "longer-word"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 14))) for _ in range(40)] + ["", None, "\n\n"]
    d = documents(spark, tmp_path, texts)
    tokens = [(i, n * 1000 + k, x, (n, at - len(x), n, at)) for i, t in enumerate(texts) if t is not None for n, line in enumerate(t.split("\n")) for k, (x, at) in enumerate(zip(line.split(" "), ends(line), strict=True))]
    marks = [(i, (f + m[0], m[1], f + m[2], m[3]), m[4], m[5]) for i, t in enumerate(texts) if t is not None for f in range(0, t.count("\n") + 1, 4) for m in L.MARKS]
    rows = spans.labelled_tokens(spark.createDataFrame(tokens, f"doc_id long, pos long, x string, token {SPAN}"), spark.createDataFrame(marks, f"doc_id long, span {SPAN}, rank int, origin int"), ["doc_id"])
    want = {r["doc_id"]: [x["label"] for x in r["l"]] for r in rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("l")).collect()}
    got = L.labelled(spark, d).collect()
    assert {r["doc_id"]: [x for line in r["labels"] for x in line] for r in got} == want
    assert all([len(x) for x in r["labels"]] == [len(x) for x in r["pieces"]] for r in got) and {0, 1, 2, 3} == {x for xs in want.values() for x in xs}
    positive = F.col("doc_id") % 2 == 0
    _, rejects = spans.usable_labels(rows, ["doc_id"], positive)
    reasons = L.labelled(spark, d).select("doc_id", spans.unusable(F.flatten("labels"), positive).alias("e"))
    assert {r["doc_id"]: r["error_type"] for r in rejects.collect()} == {r["doc_id"]: r["e"] for r in reasons.collect() if r["e"]}


def ends(line):
    at, out = -1, []
    for x in line.split(" "):
        out.append(at := at + 1 + len(x))
    return out


@pytest.mark.parametrize("name", ["block_labels", "token_span_labels", "usable_files"])
def test_labelled_documents_are_not_shuffled(spark, tmp_path, name):
    assert "Exchange" not in plan(registry.QUERIES[name](spark, documents(spark, tmp_path, ["a b\nc", "d"])))


def naive_labels(t):
    """Labels of a document's words, from the columns of the three spans in every four lines."""
    origins = []
    for n, line in enumerate(t.split("\n")):
        for x, ec in zip(line.split(" "), ends(line), strict=True):
            sc = ec - len(x)
            rules = ([(sc >= 5, 0)], [(sc >= 4 and ec <= 30, 3), (ec <= 12, 0)], [(ec <= 25, 0)], [])[n % 4]
            origins.append(next((o for hit, o in rules if hit), None))
    return [2 if o is None else 1 if i and origins[i - 1] is not None else o for i, o in enumerate(origins)]


def odd_texts():
    rng = random.Random(25)
    words = ["", "a", "é", "𝄞x", "\t", "\xa0", "e\u0301", "\r", "word", "longer-word"]
    some = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 16))) for _ in range(60)]
    return [*some, None, "", "\n", "\n\n\n", " ", "      x", "abc", "a\r\nb\r\n", "a b " * 2000, "a b\n" * 2000]


def test_counts_of_labelled_documents(spark, tmp_path):
    """Whole documents, odd ones too, without a shuffle in the plan that was run."""
    found = registry.QUERIES["token_span_labels"](spark, documents(spark, tmp_path, odd_texts()))
    want = {i: naive_labels(t) for i, t in enumerate(odd_texts()) if t is not None}
    assert sorted(map(tuple, found.collect())) == [(i, *(x.count(v) for v in range(4)), hashlib.md5("".join(map(str, x)).encode()).hexdigest()) for i, x in want.items()]
    assert "Exchange" not in plan(found)


def test_reasons_of_labelled_documents(spark, tmp_path):
    """A reason or none for each document with a text, all kinds of them, without a shuffle in the plan that was run."""
    found = registry.QUERIES["usable_files"](spark, documents(spark, tmp_path, odd_texts()))
    labels = {i: set(naive_labels(t)) for i, t in enumerate(odd_texts()) if t is not None}
    want = [(i, ("answer in a negative" if x & {0, 1} else "") if i % 2 else ("" if 0 in x else "no answer labelled")) for i, x in labels.items()]
    assert sorted(map(tuple, found.collect())) == want and {(i % 2, e == "") for i, e in want} == {(0, True), (0, False), (1, True), (1, False)}
    assert "Exchange" not in plan(found)


def test_blocks_of_lines(spark):
    df = spark.createDataFrame([([[i, i] for i in range(n)],) for n in (1, 9, 10, 11, 25)], "x array<array<int>>")
    for r in df.select("x", arrays.cut_every(F.col("x"), 10).alias("b")).collect():
        assert r["b"] == [[y for x in r["x"][k : k + 10] for y in x] for k in range(0, len(r["x"]), 10)]
    tokens, labels = block_data.behind_header(F.array(F.lit("in"), F.lit("b")), F.array(F.lit("x")), F.array(F.lit(0)))
    assert tuple(df.select(tokens, labels).first()) == (["in", "b", "x"], [2, 2, 0])
    assert [r[0] for r in spark.createDataFrame([("a  bé",), ("",), (" ",)], "t string").select(text.piece_ends(F.col("t"))).collect()] == [[1, 2, 5], [0], [0, 1]]


def naive_span_words(blocks):
    found, n, out = [], {0: 0, 3: 0}, []
    for pos, tokens, labels in blocks:
        at = None
        for i, x in enumerate([*labels, 2]):
            if x != 1:
                if at is not None:
                    found.append((pos, at, labels[at], tokens[at:i]))
                at = i if x in (0, 3) else None
    for _, _, tag, words in sorted(found, key=lambda s: s[:2]):
        out += [("ans" if tag == 0 else "sf") + str(n[tag]), *words]
        n[tag] += 1
    return out


def test_span_words_of_blocks(spark):
    rng = random.Random(22)
    rows = [([(b, [f"w{rng.randrange(9)}" for _ in range(n)], [rng.choice([0, 1, 1, 2, 3]) for _ in range(n)]) for b in rng.sample(range(20), 5) for n in [rng.randrange(0, 9)]],) for _ in range(30)]
    df = spark.createDataFrame(rows, "b array<struct<block_pos:int,tokens:array<string>,labels:array<int>>>")
    assert [r[0] for r in df.select(metrics.block_span_words(F.col("b"))).collect()] == [naive_span_words(b) for (b,) in rows]


def test_bleu_keeps_pairs_as_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, None, ["a"])], "i int, r array<string>, c array<string>")
    got = metrics.bleu(df, ["i"], F.col("r"), F.col("c"))
    assert "Exchange" not in plan(got) and {r["i"]: r["bleu"] > 0 for r in got.collect()} == {1: True, 2: False}


@pytest.mark.parametrize("held", [1, 7, 10**6])
def test_bm25_in_slices(spark, monkeypatch, held):
    """However few products a task holds, and with ties that it can't see at once, the documents are those of all scores."""
    rng = random.Random(23)
    corpus = [(f"d{i:02}", None if i == 7 else [rng.choice("abcd") for _ in range(rng.randrange(1, 4))]) for i in range(60)]
    queries = [(i, [rng.choice("abcdz") for _ in range(rng.randrange(0, 5))]) for i in range(9)]
    q, c = spark.createDataFrame(queries, "item_id int, tokens array<string>"), spark.createDataFrame(corpus, "doc_id string, tokens array<string>").repartition(3)
    monkeypatch.setattr(retrieval, "HELD", held)
    monkeypatch.setattr(retrieval, "FEW", 5)
    whole = retrieval.bm25(q, c, 60).collect()
    got = retrieval.bm25(q, c, 3)
    assert len(whole) == 9 * 60
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in whole if r["rank"] <= 3)
    places = sorted(whole, key=lambda r: (r["item_id"], r["rank"]))
    assert places == sorted(whole, key=lambda r: (r["item_id"], -r["score"], r["doc_id"]))


def test_best_documents_meet_theirs_without_a_shuffle(spark, tmp_path):
    d = documents(spark, tmp_path, ["a b c", "a b", "c d e f"])
    table(spark, tmp_path, "benchmark", [(1, "a b"), (2, "c d")], "item_id long, text string")
    found = registry.QUERIES["bleu_pairs"](spark, d)
    assert "SortMergeJoin" not in plan(found) and found.count() == 6


def test_cells_keep_white_space(spark, tmp_path):
    """Messages that end in spaces or line breaks come back from CSV as they were."""
    d = documents(spark, tmp_path, ["", "", "a ", "a\n\nb", "a\t\n ", "\ra\r", '"', "a"])
    got = {r["path"]: r["message_md5"] for r in registry.QUERIES["csv_results_scan"](spark, d).collect()}
    texts = {i: "\n".join(t.split("\n")[:2]) for i, t in enumerate(["", "", "a ", "a\n\nb", "a\t\n ", "\ra\r", '"', "a"])}
    assert got == {f"repo/f{i}.py": hashlib.md5(f'say "a", en\n{t}'.encode()).hexdigest() for i, t in texts.items() if i % 7}


def test_merged_block_groups(spark, monkeypatch):
    """The first group's labels with the first other label for a 2, of blocks held once or twice, however many tasks there are."""
    monkeypatch.setattr(block_data, "ROWS", 20)
    rng = random.Random(24)
    rows = [("q", "p", g, rng.choice("abc"), [rng.choice([0, 1, 2, 2]) for _ in range(2)]) for g in range(40) for _ in range(rng.randrange(1, 4))]
    got = block_data.merged_block_groups(spark.createDataFrame(rows, "query string, path string, grp long, block_id string, labels array<int>"), "query", "path", "grp")
    held = {}
    for _, _, g, b, x in rows:
        held.setdefault(g, {})[b] = min(x, held.get(g, {}).get(b, x))
    want = {}
    for g, bs in sorted(held.items()):
        for b, x in bs.items():
            first, labels = want.get((frozenset(bs), b), (g, x))
            want[frozenset(bs), b] = first, [new if old == 2 else old for old, new in zip(labels, x, strict=True)]
    assert sorted((r["first"], r["block_id"], r["labels"]) for r in got.collect()) == sorted((f, b, x) for (_, b), (f, x) in want.items())
    assert "SortMergeJoin" not in plan(got)
