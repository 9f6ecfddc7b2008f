"""Hierarchical multi-length packing of token sequences.

Documents are tokenised, each closed by an end id, and cut into pieces that
fill sequences.  There is a tier for each context size in ``TIERS`` (powers of
two).  Whole windows of the longest tier are cut off a long document first;
what is left is routed to the smallest tier that holds it.  A tier's windows
are packed longest piece first; a gap takes the longest piece that fits from
its own or a shorter tier, and when none fits the shortest piece on hand is
cut to the size of the gap.  So every window is full, and its length is a
power of two.  What a partition has left over at its end fills windows of
smaller and smaller powers of two, down to one token: nothing is padded.

Windows of one tier form step groups of ``STEP_TOKENS`` tokens each, so all
full groups of all tiers cost a step the same number of tokens.

There is no shuffle.  Each task packs its own rows, buffer by buffer, and ids
carry the number of the task's partition; a task that is run again gives the
same rows, as long as its input is read in the same order (files are).

Cases: a null text is the empty text, which has the end id alone; repeated
rows are packed once each; an empty table gives no row; other columns of the
input aren't read.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Context sizes, ascending; tokens of a step group; tokens that a task buffers before it packs them.
TIERS, STEP_TOKENS, BUFFER = (512, 1024, 2048, 4096), 65_536, 1 << 20
#: UTF-8 bytes of text that are tokenised at once (a longer text goes alone).
AT_ONCE = 4 << 20


class TextTokenizer:
    """Any tokenizer of ``tokenizers``: whole texts, one after the other."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the texts in them."""
        found = [np.array(self.tokenizer.encode(str(x), add_special_tokens=False).ids, np.uint32) for x in texts]
        return np.concatenate([np.empty(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])


class WordTokenizer:
    """The ids of a byte-level BPE tokenizer that lower-cases, drops white space and marks the ends of words.

    The same ids as ``TextTokenizer`` gives, from distinct words alone: a
    batch is cut at white space, its distinct words into letters, digits and
    signs, and each distinct piece is merged once, by rank.  A piece's end is
    the byte ``END``, so a vocabulary entry with the end-of-word suffix is its
    bytes and that one.  Merging by rank is merging by the list of merges, as
    ids follow that list (checked here) and every entry is reached from its
    own bytes (checked in the tests).

    Texts with a character outside ``PLAIN``, where normal forms, cases or
    classes need the tokenizer's own tables, go through it whole.
    """

    END = "\0"
    PLAIN = r"\t-\r\x20-\x{12f}\x{131}-\x{2ff}\x{400}-\x{482}\x{48a}-\x{52f}\x{2010}-\x{2027}\x{20ac}\x{2122}"
    SPACES = "[\x85\xa0]"  # those that ASCII hasn't
    #: How the tokenizer cuts a text, and its suffix.
    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+"
    SUFFIX = "</w>"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        made = [vocab[a + b] for a, b in merges]
        if model["end_of_word_suffix"] != self.SUFFIX or any(y <= x for x, y in zip(made, made[1:], strict=False)) or len(merges) and made[0] < len(vocab) - len(merges):
            raise ValueError("this tokenizer's ids don't follow its merges: use words=False")
        bytes_of = _byte_alphabet()
        entries = {}
        for name, i in vocab.items():
            stem = name.removesuffix(self.SUFFIX)
            entries[bytes(bytes_of[c] for c in stem) + self.END.encode() * (stem != name)] = i
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=entries, special_tokens={})
        self.closes = np.zeros(max(entries.values()) + 1, bool)
        self.closes[[i for name, i in vocab.items() if name.endswith(self.SUFFIX)]] = True
        self.whole = TextTokenizer(path)

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the texts in them."""
        odd = pc.match_substring_regex(texts, f"[^{self.PLAIN}]")
        plain = pc.utf8_lower(pc.if_else(odd, "", texts))
        if pc.any(pc.match_substring_regex(plain, self.SPACES)).as_py():
            plain = pc.replace_substring_regex(plain, self.SPACES, " ")
        words = pc.ascii_split_whitespace(plain)
        names = words.values.dictionary_encode()
        ids, bounds = self._merged(names.dictionary)
        at = names.indices.to_numpy()
        sizes = np.diff(bounds)[at]
        ids = ids[_runs(bounds[at], sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes)])[words.offsets.to_numpy()]
        if not pc.any(odd).as_py():
            return ids, offsets
        parts, sizes = [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], np.diff(offsets)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            parts[i] = self.whole.encode(texts[int(i) : int(i) + 1])[0]
            sizes[i] = len(parts[i])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def _merged(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words, and the words' offsets in them."""
        # a word's pieces each end in END, so the split leaves an empty one behind each word
        pieces = pc.split_pattern(pc.replace_substring_regex(words, self.PIECE, rf"\0{self.END}"), self.END)
        names = pieces.values.dictionary_encode()
        each = names.dictionary
        listed = pa.LargeListArray.from_arrays(pa.array([0, len(each)], pa.int64()), each)
        joined = pc.binary_join(listed, pa.scalar(self.END, pa.large_string()))[0].as_py() + self.END
        ids = self.merger.encode_to_numpy(joined, disallowed_special=())
        sizes = np.zeros(len(each), np.int64)
        sizes[pc.binary_length(each).to_numpy() > 0] = np.diff(np.flatnonzero(self.closes[ids]) + 1, prepend=0)
        begins = np.cumsum(sizes) - sizes
        at = names.indices.to_numpy()
        sizes = sizes[at]
        return ids[_runs(begins[at], sizes)], np.concatenate([[0], np.cumsum(sizes)])[pieces.offsets.to_numpy()]


def _byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(others)}


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str, words: bool) -> WordTokenizer | TextTokenizer:
    """One for each worker process."""
    return (WordTokenizer if words else TextTokenizer)(path)


def _slices(texts: pa.LargeStringArray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``AT_ONCE`` bytes, one row at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        yield begin, end
        begin = end


class Packer:
    """Packs documents of one task.  ``emit`` gets (document, start, length, sequence, offset, tier, step group)."""

    def __init__(self, emit: Callable[..., None], partition: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.emit, self.tiers, self.step_tokens = emit, tiers, step_tokens
        self.sequence = self.step = partition << 33
        self.open_step: dict[int, tuple[int, int]] = {}
        self.left: list[tuple[int, int, int]] = []  # (length, document, start), ascending

    def _window(self, size: int, pieces: list[tuple[int, int, int]]) -> None:
        step, used = self.open_step.get(size, (None, 0))
        if step is None or used + size > self.step_tokens:
            step, used = self.step, 0
            self.step += 1
        self.open_step[size] = step, used + size
        at = 0
        for length, doc, start in pieces:
            self.emit(doc, start, length, self.sequence, at, size, step)
            at += length
        self.sequence += 1

    def add(self, doc: int, length: int) -> None:
        most, start = self.tiers[-1], 0
        while length - start >= most:
            self._window(most, [(most, doc, start)])
            start += most
        if length > start:
            self.left.append((length - start, doc, start))

    def pack(self, last: bool = False) -> None:
        """Fills windows with all that is left; with ``last`` down to the last token, else while the longest piece's tier can be filled."""
        left = sorted(self.left)
        total = sum(x[0] for x in left)
        while left:
            size = next(t for t in self.tiers if t >= left[-1][0])
            if total < size:
                if not last:
                    break
                size = 1 << (total.bit_length() - 1)
            pieces, gap = [], size
            while gap:
                i = bisect.bisect_right(left, (gap, 1 << 62, 0)) - 1
                if i >= 0:
                    piece = left.pop(i)
                else:  # each is longer than the gap: the shortest is cut
                    length, doc, start = left.pop(0)
                    piece = (gap, doc, start)
                    bisect.insort(left, (length - gap, doc, start + gap))
                pieces.append(piece)
                gap -= piece[0]
            total -= size
            self._window(size, pieces)
        self.left = left


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, words: bool = True) -> DataFrame:
    """One row for each piece.  ``words``: the tokenizer works word by word (see WordTokenizer)."""
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")

    def run(batches):
        tokenizer = _tokenizer(tokenizer_path, words)
        rows: list[tuple] = []
        held: dict[int, tuple[int | None, np.ndarray]] = {}  # by number: id and tokens
        packer = Packer(lambda *x: rows.append(x), TaskContext.get().partitionId(), tiers)

        def flush(last=False):
            packer.pack(last)
            if not rows:
                return []
            doc, start, length, sequence, at, size, step = zip(*rows, strict=True)
            rows.clear()
            crcs = [zlib.crc32(held[d][1][a : a + n]) for d, a, n in zip(doc, start, length, strict=True)]
            columns = ([held[d][0] for d in doc], start, length, crcs, [len(held[d][1]) for d in doc], sequence, at, size, step)
            waiting = {x[1] for x in packer.left}
            for k in held.keys() - waiting:
                del held[k]
            return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)]

        number = buffered = 0
        for b in batches:
            texts = pc.fill_null(b.column(1), "").cast(pa.large_string())
            for begin, end in _slices(texts):
                ids, at = tokenizer.encode(texts[begin:end])
                for j, i in enumerate(b.column(0)[begin:end].to_pylist()):
                    own = np.empty(at[j + 1] - at[j] + 1, "<u4")
                    own[:-1], own[-1] = ids[at[j] : at[j + 1]], end_id
                    held[number] = i, own
                    packer.add(number, len(own))
                    number += 1
                    buffered += len(own)
                if buffered >= BUFFER:
                    yield from flush()
                    buffered = 0
        yield from flush(last=True)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(d, run, ", ".join(f"{n} long" for n in names))
