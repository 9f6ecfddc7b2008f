"""A file as blocks: functions, the rest of each class, the rest of the module.

Statements come from a scanner of logical lines that knows strings, brackets,
comments and continuations, and nesting comes from indentation; so Python 2
and half-finished files can be cut up as well.  All lines are 0-based.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from .mro import linearized

MODULE = "module"
#: How every order of classes begins; that of the module has no more.
LEVEL = ("__", "__class__")
#: Statements whose bodies count as the level they stand on.
OPEN = frozenset("if elif else try except finally with".split())
WORD = re.compile(r"[A-Za-z_]\w*")
PREFIX = re.compile(r"(?i)^(?:[rbuf]|br|rb|ur|fr|rf)$")


@dataclass
class Block:
    kind: str
    start: int
    end: int
    others: tuple[int, ...]
    content: str
    metadata: str
    header: str = MODULE
    mro: tuple[str, ...] = LEVEL
    relevant: bool = False

    @property
    def name(self) -> str:
        return self.metadata.split(".")[-1]

    @property
    def owner(self) -> str:
        return (["", *self.metadata.split(".")])[-2]

    def lines(self) -> list[int]:
        return list(self.others) or list(range(self.start, self.end + 1))

    def same(self, other: Block) -> bool:
        """Equal in place and text, whatever their relevance."""
        return replace(self, relevant=False) == replace(other, relevant=False)

    def placed(self, other: Block) -> bool:
        """Equal in place."""
        return (self.start, self.end, self.others) == (other.start, other.end, other.others)

    def within(self, other: Block) -> bool:
        return self.start >= other.start and self.end <= other.end


@dataclass
class Statement:
    start: int
    end: int
    indent: int
    text: str
    colon: int  # place of the colon that opens a body, in text; -1 without one
    body: list[Statement] = field(default_factory=list)

    @property
    def word(self) -> str:
        m = WORD.match(self.text)
        w = m[0] if m else ""
        if w == "async":
            m = WORD.match(self.text[5:].lstrip())
            return m[0] if m else ""
        return w

    @property
    def named(self) -> str:
        m = re.search(r"(?:def|class)\s+([A-Za-z_]\w*)", self.text)
        return m[1] if m else ""

    @property
    def last(self) -> int:
        return max([self.end, *(s.last for s in self.body[-1:])])


def statements(source: str) -> list[Statement]:
    """Logical lines in order, without blank lines and comments."""
    out: list[Statement] = []
    lines = source.split("\n")
    i = 0
    while i < len(lines):
        stripped = lines[i].strip()
        if not stripped or stripped[0] == "#":
            i += 1
            continue
        indent = len(lines[i].expandtabs()) - len(lines[i].expandtabs().lstrip())
        begin, depth, quote, colon, at = i, 0, "", -1, len(lines[i]) - len(lines[i].lstrip())
        text: list[str] = []
        size = 0
        while True:
            line, j, joined = lines[i], at, False
            while j < len(line):
                c = line[j]
                if quote:
                    if c == "\\":
                        j += 2
                        joined = j > len(line)
                        continue
                    if line.startswith(quote, j):
                        j += len(quote)
                        quote = ""
                        continue
                elif c in "\"'":
                    quote = c * 3 if line.startswith(c * 3, j) else c
                    j += len(quote)
                    continue
                elif c == "#":
                    break
                elif c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth = max(0, depth - 1)
                elif c == ":" and not depth and colon < 0:
                    colon = size + j - at
                elif c == "\\" and j == len(line.rstrip()) - 1:
                    joined = True
                j += 1
            text.append(line[at:])
            size += len(line) - at + 1
            if len(quote) == 1 and not joined:
                quote = ""  # an open string ends with its line
            if i + 1 >= len(lines) or not (quote or depth or joined):
                break
            i, at = i + 1, 0
        out.append(Statement(begin, i, indent, "\n".join(text), colon))
        i += 1
    return out


def tree(source: str) -> list[Statement]:
    """Statements with those more indented beneath them."""
    roots: list[Statement] = []
    stack: list[Statement] = []
    for s in statements(source):
        while stack and stack[-1].indent >= s.indent:
            stack.pop()
        (stack[-1].body if stack else roots).append(s)
        stack.append(s)
    return roots


def _bases(header: str) -> list[str]:
    """Names between the last bracket and its end; keyword arguments count."""
    if "(" not in header:
        return []
    inner = header[header.rindex("(") + 1 :]
    return [x.strip() for x in inner.split("):")[0].rstrip("):").split(",") if x.strip()]


def import_lines(statement: str) -> list[str]:
    """A statement for each name that an import statement brings.

    >>> import_lines("from m import (a,\\n  b as c)")
    ['from m import a', 'from m import b as c']
    """
    m = re.match(r"(from\s+\S+\s+import|import)\b(.*)", statement.split("#")[0] if "\n" not in statement else statement, re.S)
    if not m:
        return []
    head = " ".join(m[1].split())
    names = re.sub(r"#[^\n]*", "", m[2]).translate(str.maketrans("()\\\n;", "     ")).split(",")
    return [f"{head} {' '.join(n.split())}" for n in names if n.strip()]


class Program:
    """A source file, cut up once."""

    def __init__(self, source: str):
        self.source, self.text = source, source.split("\n")
        self.functions: list[Block] = []
        self.classes: list[Block] = []
        self.headers: dict[str, str] = {}
        self.roots = tree(source)
        self._walk(self.roots, "root", None, False)
        self.bases = {c.name: _bases(c.header) for c in self.classes}
        for b in [*self.functions, *self.classes]:
            if b.kind == "CLASS_FUNCTION":
                b.mro = (*LEVEL, *self.mro(b.owner))
            elif b.kind == "CLASS":
                b.mro = (*LEVEL, *self.bases[b.name])
        self.blocks = [*self.functions, *self._rest()]

    def _walk(self, body: list[Statement], path: str, owner: Block | None, conditional: bool) -> None:
        decorated = None
        for s in body:
            if s.text.startswith("@"):
                decorated = decorated or s
                continue
            first, decorated = decorated or s, None
            if s.word == "def" and s.colon >= 0:
                column = len(self.text[first.start]) - len(self.text[first.start].lstrip())
                content = "\n".join([self.text[first.start][column:], *self.text[first.start + 1 : s.last + 1]])
                self.functions.append(Block("CLASS_FUNCTION" if owner else "MODULE_FUNCTION", first.start, s.last, (), content, f"{path}.{s.named}", owner.header if owner else MODULE))
            elif s.word == "class" and s.colon >= 0 and (owner is None or conditional):
                cls = Block("CLASS", first.start, s.last, (), "", f"root.{s.named}", s.text[: s.colon + 1])
                self.classes.append(cls)
                self._walk(s.body, cls.metadata, cls, conditional)
            elif s.word in OPEN:
                self._walk(s.body, path, owner, conditional or owner is None)

    def _rest(self) -> list[Block]:
        inside = {i for f in self.functions for i in range(f.start, f.end + 1)}
        out, taken = [], set(inside)
        for c in self.classes:
            own = tuple(i for i in range(c.start, c.end + 1) if i not in taken)
            taken.update(own)
            out.append(Block("CLASS_OTHER", c.start, c.end, own, "\n".join(self.text[i] for i in own), c.metadata, MODULE, c.mro))
        rest = tuple(i for i in range(len(self.text)) if i not in taken)
        if rest:
            out.append(Block("MODULE_OTHER", 0, len(self.text) - 1, rest, "\n".join(self.text[i] for i in rest), "root"))
        return out

    def mro(self, name: str) -> list[str]:
        return linearized(self.bases, name)

    def parents(self, name: str) -> list[Block]:
        """Classes of this file that ``name`` comes from, nearest first."""
        return self._closure(name, lambda c, done: c.name in {b for d in done for b in self.bases.get(d, ())})

    def children(self, name: str) -> list[Block]:
        """Classes of this file that come from ``name``."""
        return self._closure(name, lambda c, done: not set(self.bases[c.name]).isdisjoint(done))

    def _closure(self, name, reached) -> list[Block]:
        done, out = {name}, []
        while found := [c for c in self.classes if c.name not in done and reached(c, done)]:
            out += found
            done.update(c.name for c in found)
        return out

    def local_block(self, start: int, end: int) -> Block | None:
        """First block that holds both lines."""
        for b in self.blocks:
            lines = set(b.lines()) if b.others or b.kind.endswith("OTHER") else None
            if (start in lines and end in lines) if lines is not None else (b.start <= start and end <= b.end):
                return b
        return None

    def local_class(self, start: int, end: int) -> Block | None:
        return next((c for c in self.classes if c.start <= start and end <= c.end), None)

    def function_by_mro(self, func: str, cls: str) -> Block | None:
        """The method that ``cls`` gets: of the first class in its order that has it here, else a stub of the first built-in one, else none."""
        for name in self.mro(cls):
            for b in self.functions:
                if b.kind == "CLASS_FUNCTION" and b.owner == name and b.name == func:
                    return b
        for name in self.mro(cls):
            if name in BUILTINS:
                return next(b for b in stub_blocks(name, func) if b.name == func)
        return None

    def imports(self) -> Block:
        """All import statements of the file, one name each, as a block of their lines; it isn't a part of the file as it stands."""
        found: list[tuple[str, int, int]] = []

        def walk(body: list[Statement]) -> None:
            for s in body:
                if s.word in ("import", "from") and s.colon < 0:
                    found.extend((line, s.start, s.end) for line in import_lines(s.text))
                walk(s.body)

        walk(self.roots)
        lines = tuple(i for _, a, b in found for i in range(a, b + 1))
        return Block("IMPORT", -1, -1, lines, "\n".join(x for x, _, _ in found), "", "", ())

    def module(self) -> Block:
        """The whole file as one block."""
        return Block("root", 0, len(self.text) - 1, (), self.source, "", MODULE, LEVEL)


# Built-in types that have stubs, and the stubs, as block ids hash their text.
BUILTINS = ("list", "dict", "set", "frozenset", "tuple", "bool", "int", "float", "complex", "str", "NoneType", "None")
CALL_STUB = """\
class <builtin_type>(object):
    def __call__(self):
        raise NotImplementedError"""
EQ_STUB = """\
class <builtin_type>(object):
    def __eq__(self, value):
        return self==value"""
CUSTOM_STUB = """\
class <builtin_type>(object):
    def <function_name>(self):
        raise NotImplementedError"""


def stub_source(cls: str, func: str, template: str = CUSTOM_STUB) -> str:
    return template.replace("<builtin_type>", cls).replace("<function_name>", func)


def stub_blocks(cls: str, func: str, template: str = CUSTOM_STUB, marked: bool = True) -> list[Block]:
    """Blocks of a stand-in class, which have no place in the file; ``marked`` ones say so in their headers."""
    made = Program(stub_source(cls, func, template)).blocks
    return [replace(b, kind="STUB", start=-1, end=-1, header=f"STUB {b.header}" if marked else b.header) for b in made]
