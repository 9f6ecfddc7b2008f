"""The word tokenizer against the library's, over its whole vocabulary and odd characters; packing of awkward tables."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def both(library, texts):
    ids, at = packing._tokenizer(PATH, True).encode(pa.array(texts, pa.large_string()))
    got = [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    return got, [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_entry_is_reached_from_its_own_bytes():
    """Then merging by rank and merging by the list of merges agree."""
    model = json.load(open(PATH, encoding="utf-8"))["model"]
    rank = {tuple(m): i for i, m in enumerate(model["merges"])}
    for name in model["vocab"]:
        stem = name.removesuffix("</w>")
        parts = list(stem)
        if stem != name:
            parts[-1] += "</w>"
        while len(parts) > 1:
            i = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            assert (parts[i], parts[i + 1]) in rank, name
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [name]


ODD = "aZ '’s09²½ⅷ_-.,;!?\t\n\v\f\r\x1c\x85\xa0　 —éÉßİıſŉǅΣςΰЖйё́漢字😀\x00\x01­$€™<|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(ODD), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_ids_are_the_library_s(library, texts):
    got, want = both(library, texts)
    assert got == want


def test_ids_of_single_characters(library):
    texts = [f"a{chr(c)}b{chr(c).upper()}'S {chr(c)}{chr(c)}" for c in range(0x2FFF) if not 0xD800 <= c < 0xE000]
    got, want = both(library, texts)
    assert [t for t, x, y in zip(texts, got, want, strict=True) if x != y] == []


def test_special_tokens_in_a_text_are_text(library):
    got, want = both(library, ["a <|endoftext|> b<|startoftext|>", "", "don't we'll I'D"])
    assert got == want and 49407 not in got[0]


def check(library, rows, got):
    """Every id once, gapless sequences of full powers of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(pieces[i, len(ids)], key=lambda r: r["start"])
        spans = {(r["start"], r["length"]) for r in mine}
        times = sum(1 for x in rows if x == (i, text))
        assert sum(r["length"] for r in mine) == len(ids) * times
        for a, n in spans:
            assert any(r["ids_crc32"] == zlib.crc32(ids[a : a + n].tobytes()) for r in mine if (r["start"], r["length"]) == (a, n))
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == s[0]["sequence_length"] <= 4096 and at & (at - 1) == 0


def test_awkward_table(spark, library):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    rows = [(i, words(rng.randrange(1, 700))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "no id"), (103, words(60_000)), (104, "漢字 " * 3000), (7, rows[7][1]), (7, rows[7][1]), (105, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, sequence_id int").repartition(3).cache()
    got = packing.pack(docs, PATH, 2).collect()
    check(library, rows, got)
    assert sorted(got, key=str) == sorted(packing.pack(docs, PATH, 2).collect(), key=str)  # a task that is run again gives the same rows
    assert packing.pack(docs.limit(0), PATH, 2).collect() == []
    docs.unpersist()


def test_long_text_goes_alone():
    texts = pa.array(["a" * 10, "b" * (packing.AT_ONCE + 5), "c", ""], pa.large_string())
    assert list(packing._slices(texts)) == [(0, 1), (1, 2), (2, 4)]
    assert list(packing._slices(pa.array([], pa.large_string()))) == []
