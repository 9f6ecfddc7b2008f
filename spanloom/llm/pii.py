"""Personal data: e-mail addresses, IP addresses, card and phone numbers.

Plain identifiers come from fixed patterns.  Disguised ones come from small
transducers that rewrite a text and keep, for each character they give, the
source characters it stands for: look-alike letters and digits become ASCII,
invisible characters go, runs of spelled digits become digits, ``(at)``,
``[dot]`` and ``name at host dot org`` become ``@`` and ``.``.  The same
patterns run over the result, and what they find is mapped back to the source.
Disguised finds are added where no plain one of that kind overlaps.

A text without a disguise isn't rewritten, so ordinary words like *at* and
*one* change nothing: *at* needs brackets or a spelled *dot* after it, spelled
digits need a run of ``RUN``.

Cases: a null text is the empty text; a text is searched whole, in time linear
in its length; repeated rows give repeated results; an empty table gives no
row; other columns are kept by ``redact`` and not read by ``find``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Spelled digits in a row that count as a number.
RUN = 4

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of plain identifiers by kind: leftmost, non-overlapping; matches that fail a test are gone."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        last, at = 0, text.find("@")
        while at >= 0:
            if m := HOST.match(text, at):
                begin = at
                while begin > last and text[begin - 1] in LOCAL:
                    begin -= 1
                if begin < at:
                    out["email"].append((begin, m.end()))
                    last = m.end()
            at = text.find("@", max(at + 1, last))
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


_ALIKE = {
    "a": "аɑαа", "b": "Ьь", "c": "сϲ", "d": "ԁ", "e": "еҽ℮", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κк", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν", "w": "ԝѡ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    "@": "＠﹫", ".": "．․。｡·∙•", "-": "‐‑‒–—−﹣－", "+": "＋﹢", "_": "＿", " ": "      　",
}
HOMOGLYPHS = {c: to for to, cs in _ALIKE.items() for c in cs}
INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")
#: Characters of the Latin-1 and Latin Extended blocks are letters of their languages; what may be a disguise lies beyond, but for those of the tables.
ODD = re.compile("[" + re.escape("".join(sorted({*HOMOGLYPHS, *INVISIBLE} - {chr(i) for i in range(128)}))) + "­ıɑɡͰ-׿ᴀ-ᵿ​-‏‐-―․•⁠⁰-₟℀-↏−∙①-⒛　。︀-￯\U0001d400-\U0001d7ff]")

_SPELLED = ("zero oh null nul zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
DIGITS = {w: str(i) for i, ws in enumerate(_SPELLED) for w in ws.split()}
_D = "|".join(sorted(DIGITS, key=len, reverse=True))
_SEP = r"(?:[ ]?[,-][ ]?|[ ])"
_DOT = r"(?:dot|punkt|point|punto)"
_TOKEN = rf"(?:{_D}|{_DOT}|[0-9])"
NUMBER = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ ]?)?(?:{_D})(?!\w)(?:{_SEP}{_TOKEN}(?!\w)){{{RUN - 1},}}+", re.I)
PIECE = re.compile(rf"{_D}|{_DOT}|plus|[0-9+]", re.I)
_AT = r"(?:at|arroba|chez)"
BRACKET_AT = re.compile(rf"[ ]?[(\[{{<][ ]?(?:{_AT}|@)[ ]?[)\]}}>][ ]?", re.I)
BRACKET_DOT = re.compile(rf"[ ]?[(\[{{<][ ]?(?:{_DOT}|\.)[ ]?[)\]}}>][ ]?", re.I)
_LABEL = rf"[A-Za-z0-9]++(?:-++(?!{_DOT}[ _-])[A-Za-z0-9]++)*+"
_HOST = rf"{_LABEL}(?:[ _-]{_DOT}[ _-]{_LABEL}){{1,4}}+"


def _local(char: str) -> str:
    return rf"(?<![A-Za-z0-9_%+-]){char}++(?:(?:[ ]{_DOT}[ ]|\.){char}++){{0,4}}+"


# first a local part that may hold "-at-" itself, then one that ends before it
SPELLED_AT = re.compile(rf"(?:{_local('[A-Za-z0-9_%+-]')}(?P<at>[ ]{_AT}[ _-])|{_local(f'(?:(?![_-]{_AT}[ _-])[A-Za-z0-9_%+-])')}(?P<sep>[_-]{_AT}[ _-])){_HOST}", re.I)
SPELLED_DOT = re.compile(rf"[ ]{_DOT}[ ]", re.I)
HOST_DOT = re.compile(rf"[ _-]{_DOT}[ _-]", re.I)
AT_HOST = re.compile(rf"@{_LABEL}(?:(?:[ _-]{_DOT}[ _-]|\.){_LABEL})++", re.I)
HINT_DOT = re.compile(rf"{_DOT}|[(\[{{<][ ]?\.", re.I)


class Source:
    """A text under rewriting: its characters and, for each, the first and last source position."""

    def __init__(self, text: str):
        self.text, self.begins, self.ends = text, range(len(text)), range(1, len(text) + 1)
        self.changed = False

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces the spans, given in order."""
        if not edits:
            return
        parts, begins, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            begins += [*self.begins[at:a], *[self.begins[a]] * len(new)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)]
            at = b
        parts.append(self.text[at:])
        self.text, self.begins, self.ends = "".join(parts), [*begins, *self.begins[at:]], [*ends, *self.ends[at:]]
        self.changed = True


def look_alikes(s: Source) -> None:
    if s.text.isascii() or not ODD.search(s.text):
        return
    edits = []
    for m in ODD.finditer(s.text):
        c = m[0]
        new = "" if c in INVISIBLE else HOMOGLYPHS.get(c)
        if new is None:
            new = unicodedata.normalize("NFKC", c)
            if not new.isascii():
                d = unicodedata.digit(c, None)
                new = c if d is None else str(d)
        if new != c:
            edits.append((m.start(), m.end(), new))
    s.rewrite(edits)


def spelled_digits(s: Source) -> None:
    edits = []
    for m in NUMBER.finditer(s.text):
        pieces = [x.lower() for x in PIECE.findall(m[0])]
        new = "".join(DIGITS.get(x) or ("+" if x in ("plus", "+") else "." if x not in "0123456789" else x) for x in pieces)
        if sum(x in DIGITS for x in pieces) >= RUN:
            edits.append((m.start(), m.end(), new))
    s.rewrite(edits)


def at_and_dot(s: Source) -> None:
    for pattern, new in ((BRACKET_AT, "@"), (BRACKET_DOT, ".")):
        s.rewrite([(*m.span(), new) for m in pattern.finditer(s.text)])
    if "@" in s.text:  # an at, plain or once in brackets, may be followed by a spelled dot
        s.rewrite([(*d.span(), ".") for m in AT_HOST.finditer(s.text) for d in HOST_DOT.finditer(s.text, *m.span())])
    if HINT_DOT.search(s.text):
        edits = []
        for m in SPELLED_AT.finditer(s.text):
            at, end = m.span("at" if m["at"] else "sep")
            edits += [(*d.span(), ".") for d in SPELLED_DOT.finditer(s.text, m.start(), at)]
            edits.append((at, end, "@"))
            edits += [(*d.span(), ".") for d in HOST_DOT.finditer(s.text, end, m.end())]
        s.rewrite(edits)



def spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Spans of plain identifiers, and of all, by kind.

    >>> spans("mail jo (at) ex (dot) org")[1]["email"]
    [(5, 25)]
    """
    base = plain(text)
    s = Source(text)
    look_alikes(s)
    spelled_digits(s)
    at_and_dot(s)
    if not s.changed:
        return base, base
    every = {}
    for kind, found in plain(s.text).items():
        more = [(s.begins[a], s.ends[b - 1]) for a, b in found]
        every[kind] = sorted({*base[kind], *(x for x in more if not any(x[0] < b and a < x[1] for a, b in base[kind]))})
    return base, every


def digest(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of plain identifiers by kind, a digest of their spans, and all spans, for every row."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for b in batches:
            found = [spans(t) for t in texts_of(b.column(1))]
            base = [digest(x) for x, _ in found]
            counts = [pa.array([len(x[k]) for x, _ in found], pa.int64()) for k in KINDS]
            added = pa.array([sum(len(y[k]) - len(x[k]) for k in KINDS) for x, y in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([digest(y) for _, y in found], pa.string()), added], names=names)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(d, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str) -> str:
    """``text`` with every find replaced by its kind in angle brackets; of overlapping finds the first (then longest) names the place."""
    _, every = spans(text)
    marks = sorted((a, -b, k) for k in KINDS for a, b in every[k])
    if not marks:
        return text
    out, at = [], 0
    for a, b, k in marks:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns and rows of ``docs``, with personal data in the text masked; null stays null."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([None if t is None else masked(t) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(docs, run, docs.schema)
