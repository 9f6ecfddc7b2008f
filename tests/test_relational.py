"""Operators outside the training-data subpackage against plain Python."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions import arrays, maths, text
from spanloom.operators import block_data, metrics, relational, retrieval, sampling, source, spans, vocab
from spanloom.operators.lineage import new_path
from spanloom.sources import readers, writers

SPAN = "struct<sl:int,sc:int,el:int,ec:int>"


def one(spark, *columns, rows=((1,),), schema="x int"):
    return [tuple(r) for r in spark.createDataFrame(list(rows), schema).select(*columns).collect()]


def naive_spans(labels):
    out, open_ = [], None
    for i, x in enumerate(labels):
        if x != 1:
            if open_ is not None:
                out.append((*open_, i - 1))
            open_ = (x, i) if x in (0, 3) else None
    return out + ([(*open_, len(labels) - 1)] if open_ is not None else [])


def test_label_arrays(spark):
    rng = random.Random(1)
    rows = [([rng.choice([0, 1, 1, 2, 3, 4]) for _ in range(rng.randrange(0, 12))],) for _ in range(200)] + [(None,)]
    df = spark.createDataFrame(rows, "l array<int>")
    for r in df.select("l", arrays.spans(F.col("l")).alias("s"), arrays.first_separator(F.col("l")).alias("f"), arrays.segment_ids(F.col("l"), F.lit(4)).alias("g")).collect():
        if r["l"] is None:
            assert r["s"] is None and r["f"] is None
            continue
        assert [tuple(x) for x in r["s"]] == naive_spans(r["l"])
        assert r["f"] == next((i for i in range(len(r["l"]) - 1) if r["l"][i] == 4 and r["l"][i + 1] != 4), None)
        at = r["l"].index(4) + 1 if 4 in r["l"] else len(r["l"])
        assert r["g"] == [0] * at + [1] * (len(r["l"]) - at)


def test_runs_of_rows_are_those_of_arrays(spark):
    rng = random.Random(12)
    rows = [(i, [rng.choice([0, 1, 1, 2, 3, 4]) for _ in range(rng.randrange(0, 15))]) for i in range(60)]
    long = spark.createDataFrame([(i, p, x) for i, ls in rows for p, x in enumerate(ls)], "k int, pos int, label int")
    got = sorted((r["k"], r["tag"], r["first"], r["last"]) for r in spans.runs(long, ["k"]).collect())
    assert got == sorted((i, *s) for i, ls in rows for s in naive_spans(ls))


def test_exact_match_by_kind(spark):
    df = spark.createDataFrame([([0, 1, 2, 3], [0, 1, 2, 2]), ([2, 2], [2, 2]), ([0, 2, 3, 1], [0, 2, 3, 1])], "t array<int>, p array<int>")
    got = {k: [r["em"] for r in metrics.exact_match(df, F.col("t"), F.col("p"), k).collect()] for k in ("both", "answer", "sf")}
    assert got == {"both": [0, 1, 1], "answer": [1, 1, 1], "sf": [0, 1, 1]}


def test_windows_and_back(spark):
    rows = [(list(range(n)),) for n in (0, 3, 9, 10, 11, 40, 64, 65)]
    df = spark.createDataFrame(rows, "w array<int>")
    whole = df.select("w", arrays.windows(F.col("w"), F.lit(3), 10).alias("c")).select("*", arrays.rejoined(F.col("c"), F.lit(3)).alias("r"), arrays.n_windows(F.col("w"), F.lit(3), 10).alias("n"))
    for r in whole.collect():
        assert r["r"] == r["w"] and len(r["c"]) == r["n"] and max(map(len, r["c"])) <= 10
    each = df.select("w", F.explode(F.sequence(F.lit(0), arrays.n_windows(F.col("w"), F.lit(3), 10) - 1)).alias("i")).select("w", "i", arrays.window(F.col("w"), F.col("i"), F.lit(3), 10).alias("c"))
    want = {(len(r["w"]), i): c for r in whole.collect() for i, c in enumerate(r["c"])}
    assert {(len(r["w"]), r["i"]): r["c"] for r in each.collect()} == want


def test_arrays_of_every_kind(spark):
    got = one(spark, arrays.line_list(F.lit(2), F.lit(4), F.array().cast("array<int>")), arrays.line_list(F.lit(0), F.lit(9), F.array(F.lit(7))), arrays.best_label(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))), arrays.opened(F.array(*map(F.lit, [1, 1, 2, 1])), F.array(*map(F.lit, [0, 0, 0, 3]))))
    assert got == [([2, 3, 4], [7], 1, [0, 1, 2, 3])]


def test_expected_best(spark):
    rng = random.Random(2)
    for n, k, m in ((10, 3, 10), (10, 1, 4), (6, 6, 6), (10, 5, 0)):
        xs = [rng.random() for _ in range(m)]
        padded = xs + [0.0] * (n - m)
        want = sum(max(c) for c in itertools.combinations(padded, k)) / math.comb(n, k)
        got = one(spark, maths.expected_best(F.col("x"), n, k), rows=[(xs,)], schema="x array<double>")[0][0]
        assert abs(got - want) < 1e-12
    with pytest.raises(Exception, match="more than 2 scores"):
        one(spark, maths.expected_best(F.col("x"), 2, 1), rows=[([1.0, 2.0, 3.0],)], schema="x array<double>")


def test_pass_at_k(spark):
    for n, c, k in ((10, 3, 1), (10, 3, 5), (10, 0, 2), (10, 9, 2), (10, 10, 1)):
        want = 1 - math.comb(n - c, k) / math.comb(n, k)
        got = one(spark, maths.pass_at_k(F.col("n"), F.col("c"), k), rows=[(n, c)], schema="n int, c int")[0][0]
        assert abs(got - want) < 1e-12


def naive_bm25(queries, corpus, top):
    n, avg = len(corpus), sum(len(t) for _, t in corpus) / len(corpus)
    df = Counter(w for _, t in corpus for w in set(t))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = []
    for q, words in queries:
        scores = []
        for d, t in corpus:
            tf = Counter(t)
            s = sum((floor if raw.get(w, 0) < 0 else raw.get(w, 0)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in words if w in tf)
            scores.append((-round(s, 6), d))
        out += [(q, d, i + 1, -s) for i, (s, d) in enumerate(sorted(scores)[:top])]
    return out


@pytest.mark.parametrize("few", [200_000, 1])
def test_bm25_with_unmatched_queries(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW", few)
    rng = random.Random(3)
    corpus = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))]) for i in range(30)]
    queries = [(1, ["a", "b", "a"]), (2, ["zz"]), (3, []), (4, ["h", "nope"]), (5, list("abcdefgh"))]
    q, c = spark.createDataFrame(queries, "item_id int, tokens array<string>"), spark.createDataFrame(corpus, "doc_id int, tokens array<string>")
    for top in (1, 4, 30):
        got = sorted((r["item_id"], r["doc_id"], r["rank"], r["score"] + 0.0) for r in retrieval.bm25(q, c, top).collect())
        want = sorted(naive_bm25(queries, corpus, top))
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_bm25_of_frequent_words_alone(spark):
    """With negative mean weights, documents without a token come first."""
    corpus = [(1, ["a", "b"]), (2, ["a", "b"]), (3, ["a", "b"]), (4, ["c"])]
    q, c = spark.createDataFrame([(1, ["a"])], "item_id int, tokens array<string>"), spark.createDataFrame(corpus, "doc_id int, tokens array<string>")
    assert [(r["doc_id"], r["rank"]) for r in retrieval.bm25(q, c, 4).orderBy("rank").collect()] == [(d, i) for _, d, i, _ in naive_bm25([(1, ["a"])], corpus, 4)]


def test_bleu(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randrange(0, 9))], [rng.choice("abcd") for _ in range(rng.randrange(0, 9))]) for i in range(60)]
    got = {r["i"]: r["bleu"] for r in metrics.bleu(spark.createDataFrame(rows, "i int, r array<string>, c array<string>"), ["i"], F.col("r"), F.col("c")).collect()}
    for i, r, c in rows:
        grams = lambda t, n: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
        h = [sum((grams(c, n) & grams(r, n)).values()) for n in (1, 2, 3, 4)]
        total = [max(len(c) - n + 1, 1) for n in (1, 2, 3, 4)]
        want = 0.0 if not c or not h[0] else math.exp((0 if len(c) >= len(r) else 1 - len(r) / len(c)) + (math.log(h[0] / total[0]) + sum(math.log((h[n] + 1) / (total[n] + 1)) for n in (1, 2, 3))) / 4)
        assert abs(got[i] - want) < 1e-9


def test_generations(spark):
    gold, facts = "a:::-:::b", "f"
    ok = "```python\nb\na\n```\nSupporting fact span(s)\n```python\nf\n```"
    got = one(spark, metrics.correct(F.lit(gold), F.array(*map(F.lit, ["b\n a ", "a", " ", "a\nb\nb"]))), metrics.correct_with_facts(F.lit(gold), F.lit(facts), F.array(*map(F.lit, [ok, ok.replace("f\n", "g\n"), "b\na", ""]))), text.split_spans(F.lit(gold)), text.split_spans(F.lit("N/A")))
    assert got == [(1, 1, ["a", "b"], [])]


def test_facts_in_the_order_of_their_places(spark):
    s = lambda *x: f"named_struct('sl',{x[0]},'sc',{x[1]},'el',{x[2]},'ec',{x[3]})"
    arr = lambda *xs: F.expr(f"array({','.join(xs)})")
    got = one(spark, F.transform(spans.accepted_facts(arr(s(1, 0, 1, 5)), arr(s(4, 0, 4, 3), s(2, 0, 3, 4), s(1, 5, 1, 9), s(3, 2, 3, 8), s(4, 4, 5, 1))), lambda x: F.concat_ws(":", x["sl"], x["sc"])))
    assert got == [(["2:0", "4:0", "4:4"],)]  # one touches the result, one overlaps an accepted fact


def test_labelled_files(spark):
    rows = [("p", 0, True), ("p", 1, True), ("q", 2, True), ("n", 2, False), ("m", 1, False)]
    kept, rejects = spans.usable_labels(spark.createDataFrame(rows, "f string, label int, pos boolean"), ["f"], F.col("pos"))
    assert sorted(r[0] for r in kept.collect()) == ["n", "p"]
    assert {r[0]: r[1] for r in rejects.collect()} == {"q": "no answer labelled", "m": "answer in a negative"}


def test_layout_tokens_hand_their_letter_on(spark):
    rows = [("a", i, t, x) for i, (t, x) in enumerate([("___NL___", 0), ("___INDENT___", 1), ("x", 1), ("y", 1), ("___DEDENT___", 3), ("___NEWLINE___", 2), ("z", 1), ("___NL___", 0), ("w", 2)])]
    got = vocab.without_layout(spark.createDataFrame(rows, "k string, pos int, token string, label int"), ["k"]).orderBy("pos").collect()
    assert [(r["token"], r["label"]) for r in got] == [("x", 0), ("y", 1), ("z", 1), ("w", 2)]


def test_subwords(spark):
    split = vocab.subwords(frozenset(["ab", "abc", "c_", "d"]))
    got = one(spark, split(F.col("t")), rows=[("abc",), ("abd",), ("é",), ("",), (None,)], schema="t string")
    assert [r[0] for r in got] == [["abc", "_"], ["ab", "d", "_"], ["é", "_"], ["_"], None]


def test_row_index_and_splits(spark):
    rng = random.Random(6)
    keys = rng.sample(range(10_000), 700)
    df = spark.createDataFrame([(k, "x") for k in keys], "id long, v string")
    for parts in (2, 5, 64):
        got = {r["id"]: r["idx"] for r in relational.row_index(df, "id", parts).collect()}
        assert got == {k: i for i, k in enumerate(sorted(keys))}
    split = Counter(r["split_id"] for r in relational.contiguous_splits(df, "id", 9).collect())
    assert set(split) == set(range(1, 10)) and max(split.values()) - min(split.values()) <= 1
    assert relational.contiguous_splits(df.filter("false"), "id", 9).count() == 0


def test_smallest_ranks(spark, monkeypatch):
    import hashlib

    rank = lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i)
    df = spark.createDataFrame([(i,) for i in range(3000)], "id int")
    order = sorted(range(3000), key=rank)
    for edge in (1, 3):
        monkeypatch.setattr(sampling, "EDGE", edge)
        for n in (0, 1, 17, 2999, 3000, 5000):
            assert sorted(r[0] for r in sampling.smallest(df, n, ["id"]).collect()) == sorted(order[:n])
    assert sampling.negatives(df, F.col("id") < 10, ["id"]).count() == 40
    assert [r[0] for r in sampling.one_example(df, ["id"]).collect()] == order[:1]


def test_ancestors_of_any_depth(spark):
    edges = [("h", f"c{i}", f"c{i + 1}") for i in range(40)] + [("h", "x", "y"), ("h", "y", "x"), ("g", "s", "s"), ("g", "a", "b")]
    got = {(r[0], r[1], r[2]): r[3] for r in source.ancestors(spark.createDataFrame(edges, "hierarchy string, child string, parent string")).collect()}
    assert got["h", "c0", "c40"] == 40 and sum(k[1] == "c0" for k in got) == 40
    assert got["h", "x", "y"] == 1 and ("h", "x", "x") not in got and got["g", "s", "s"] == 1
    assert source.ancestors(spark.createDataFrame([], "hierarchy string, child string, parent string")).count() == 0


def test_types_of_examples_are_checked(spark):
    pos, neg = spark.createDataFrame([(1, 1)], "i int, example_type int"), spark.createDataFrame([(2, 0)], "i int, example_type int")
    assert relational.both_kinds(pos, neg).count() == 2
    with pytest.raises(Exception, match="type 1"):
        relational.both_kinds(neg, neg).collect()
    path = new_path(spark, "test-splits")
    writers.splits(pos.union(neg), path, "i", 2)
    with pytest.raises(ValueError, match="different types"):
        readers.splits(spark, path)


def test_rejects_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", None, 5), ("b", 3, 1)], "k string, x int, o int")
    whole, rejects = relational.split_rejects(df, ["x"])
    assert whole.count() == 2 and [r["error_type"] for r in rejects.collect()] == ["missing coordinate"]
    assert {r["k"]: r["x"] for r in relational.last_of_each(df, ["k"], "o").collect()} == {"a": None, "b": 3}


def test_relevance_of_repeated_blocks(spark):
    blocks = F.expr("array(named_struct('lines', array(1,2), 'relevant', false), named_struct('lines', array(3), 'relevant', false), named_struct('lines', array(1,2), 'relevant', true))")
    got = one(spark, relational.with_relevance_of_same_lines(blocks))[0][0]
    assert [(list(b["lines"]), b["relevant"]) for b in got] == [([1, 2], True), ([3], False)]


def test_tokens_of_two_lines_count_once(spark):
    tokens = spark.createDataFrame([("f", 0, (0, 0, 0, 3)), ("f", 1, (1, 0, 2, 3)), ("f", 2, (5, 0, 5, 1))], f"path string, pos int, token {SPAN}")
    blocks = spark.createDataFrame([("f", "a", [0, 1]), ("f", "b", [2]), ("f", "c", [1, 2])], "path string, block_id string, lines array<int>")
    got = sorted((r["block_id"], r["pos"]) for r in block_data.block_tokens(tokens, blocks, ["path"]).collect())
    assert got == [("a", 0), ("a", 1), ("b", 1), ("c", 1)]


def test_contexts_with_facts_and_rejects(spark):
    code = "class A:\n    def m(self):\n        return 1\n\nx = 2\n"
    schema = f"finding_id long, query string, source string, message string, span {SPAN}, aux {source.AUX}, facts array<{SPAN}>"
    rows = [(1, "Redundant assignment", code, "", (4, 0, 4, 1), [], [(2, 0, 2, 3)]), (2, "Redundant assignment", code, None, (4, 0, 4, 1), None, None), (3, "Incomplete ordering", code, "", (4, 0, 4, 1), [], None), (4, "Redundant assignment", code, "", (4, 0, 4, 1), [], [(90, 0, 90, 1)])]
    kept, rejects = source.contexts(spark.createDataFrame(rows, schema))
    got = {}
    for r in kept.orderBy("finding_id", "pos").collect():
        got.setdefault(r["finding_id"], []).append(r["metadata"])
    assert got == {1: ["root", "root.A.m", "root.A"], 2: ["root"]}
    assert {r["finding_id"]: r["message"] for r in rejects.collect()} == {3: "empty context", 4: "generic: a supporting fact in no block"}
    every = source.contexts(spark.createDataFrame(rows[1:2], schema), everything=True)[0].orderBy("pos").collect()
    assert [(r["metadata"], r["relevant"]) for r in every] == [("root", True), ("root.A.m", False), ("root.A", False)]


def test_changed_lines(spark):
    df = spark.createDataFrame([("f", "x = 1", 7)], "path string, code string, line int")
    got = [(r["text"], *r["token"]) for r in source.perturbed_tokens(df, ["path"]).orderBy("pos").collect()]
    assert got[:3] == [("x", 7, 0, 7, 0), ("=", 7, 2, 7, 2), ("1", 7, 4, 7, 4)]
    with pytest.raises(Exception, match="can't be read"):
        source.perturbed_tokens(spark.createDataFrame([("f", "(", 7)], "path string, code string, line int"), ["path"]).collect()
    heads = source.header_tokens(spark.createDataFrame([("f", "class A:")], "path string, block_header string"), ["path"]).collect()
    assert {tuple(r["token"]) for r in heads} == {(-1, -1, -1, -1)}
    assert source.stub_tokens(spark.createDataFrame([("f", None)], "path string, content string"), ["path"]).count() == 1
    assert [r["text"] for r in source.query_tokens(spark.createDataFrame([("f", "a b")], "path string, name string"), ["path"]).orderBy("pos").collect()][:2] == ["a", "b"]


def test_prompts(spark):
    got = one(spark, retrieval.prompt_input(F.array(F.lit("a"), F.lit("b")), F.lit("code")), text.truncated_prompt(F.lit("abcdef"), F.lit(9), 8, 3), text.truncated_prompt(F.lit("abcdef"), F.lit(8), 8, 3))
    assert got[0][0] == ("code", "a:::-:::b") and got[0][1:] == ("abc", "abcdef")


def test_every_query_but_those_of_the_driver_has_a_stable_schema(spark):
    from spanloom.plans import registry

    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 70
