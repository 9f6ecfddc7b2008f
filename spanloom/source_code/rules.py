"""Contexts of analysis results: which blocks a query's finding needs, and which of them are relevant.

A rule gets a ``Finding`` and gives blocks in order.  A rule that gives
nothing, nothing relevant, or fails is a rejection with its reason; the other
findings go on.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from .blocks import BUILTINS, CALL_STUB, EQ_STUB, Block, Program, stub_blocks
from .mro import between

# How messages name places and calls, and the methods of an ordering.
LOCATION = re.compile(r"relative:///[a-zA-Z0-9_.]*:(\d+):(\d+):(\d+):(\d+)")
CALL = re.compile(r"\[\[(.*)\|")
ORDERING = ("__ge__", "__gt__", "__le__", "__lt__")


@dataclass
class Aux:
    """A row of the auxiliary results of the finding's file (1-based, end column inclusive)."""

    name: str
    message: str
    start_line: int
    start_col: int
    end_line: int
    end_col: int


@dataclass
class Finding:
    """A result (0-based span) in a program."""

    program: Program
    start: int
    start_col: int
    end: int
    end_col: int
    message: str = ""
    aux: list[Aux] = field(default_factory=list)

    def local(self) -> Block | None:
        return self.program.local_block(self.start, self.end)

    def local_class(self) -> Block | None:
        return self.program.local_class(self.start, self.end)


class Kept:
    """Blocks in order of their adding; a block added again keeps its place and may become relevant."""

    def __init__(self):
        self.blocks: list[Block] = []

    def add(self, block: Block | None, relevant: bool = False) -> None:
        if block is None:
            return
        for i, b in enumerate(self.blocks):
            if b.same(block):
                if relevant and not b.relevant:
                    self.blocks[i] = replace(b, relevant=True)
                return
        self.blocks.append(replace(block, relevant=relevant))

    def mark(self, choose: Callable[[Block], bool]) -> None:
        self.blocks = [replace(b, relevant=b.relevant or choose(b)) for b in self.blocks]


def is_method(b: Block, *names: str) -> bool:
    return b.kind == "CLASS_FUNCTION" and (not names or b.name in names)


def class_parts(f: Finding, classes: list[Block]) -> list[Block]:
    return [b for b in f.program.blocks if b.kind != "MODULE_OTHER" and any(b.within(c) for c in classes)]


def distributable(f: Finding) -> list[Block]:
    k = Kept()
    k.add(f.local(), True)
    return k.blocks


def unused_import(f: Finding) -> list[Block]:
    used = {i for a in f.aux if a.name == "Used import" for i in range(a.start_line - 1, a.end_line)}
    local, k = f.local(), Kept()
    for b in f.program.blocks:
        k.add(b, b.kind == "MODULE_OTHER" or (local is not None and b.same(local)) or not used.isdisjoint(b.lines()))
    return k.blocks


def equals_with_attributes(f: Finding) -> list[Block]:
    cls, k = f.local_class(), Kept()
    if cls is None:
        return []
    for b in class_parts(f, [cls, *f.program.parents(cls.name)]):
        k.add(b, b.same(f.local()))
    k.add(f.program.function_by_mro("__eq__", cls.name), True)
    k.mark(lambda b: is_method(b, "__init__"))
    return k.blocks


def _called(kind: str):
    def rule(f: Finding) -> list[Block]:
        local, k = f.local(), Kept()
        k.add(local, True)
        lines = set(local.lines())
        calls = []
        for a in f.aux:
            if a.name == kind:
                span = (a.start_line - 1, a.start_col - 1, a.end_line - 1, a.end_col)
                calls.append((CALL.findall(a.message)[0].strip('"'), span))
        own = (f.start, f.start_col, f.end, f.end_col)
        for b in f.program.functions:
            hits = []
            for name, span in calls:
                parts = name.split(".")
                alike = (b.name == parts[-1] and b.owner == parts[0]) if is_method(b) else b.name == name
                if alike and (span[0] in lines or span[2] in lines):
                    hits.append(span)
            if hits:
                k.add(b, own in hits)
        return k.blocks

    return rule


def _typed(method: str, stub: str, several: bool):
    """Blocks of the classes that a message names; ``method`` is what was called on them, ``stub`` stands for that of a built-in type."""

    def rule(f: Finding) -> list[Block]:
        local, k = f.local(), Kept()
        k.add(local, True)
        for part in f.message.split("\n") if several else [f.message]:
            first = part.split(":::")[0]
            name = first.split()[-1].strip() if first.split() else ""
            if first.startswith("class"):
                cls = next((c for c in f.program.classes if c.name == name), None)
                if cls is None:
                    for b in f.program.blocks:
                        if f"class {name}" in b.content:
                            k.add(b, True)
                    continue
                for b in class_parts(f, [cls]):
                    k.add(b)
                k.add(f.program.function_by_mro(method, name), True)
            elif first.startswith("builtin-class") and name in BUILTINS:
                for b in stub_blocks(name, method, stub, marked=not several):
                    k.add(b, b.name == method)
            else:
                for b in f.program.blocks:
                    if b.kind == "MODULE_OTHER":
                        k.add(b, True)
        return k.blocks

    return rule


def init_calls_overridden(f: Finding) -> list[Block]:
    cls, k = f.local_class(), Kept()
    if cls is None:
        return []
    local, own = f.local(), class_parts(f, [cls])
    names = {b.name for b in own if is_method(b)} - {"__init__"}
    children = f.program.children(cls.name)
    for b in f.program.blocks:
        if b.kind != "MODULE_OTHER" and not b.within(cls) and any(b.within(c) for c in children):
            k.add(b, is_method(b) and b.name in names)
    first = next((b for b in own if is_method(b, "__init__")), None)
    for b in own:
        k.add(b, b.same(local) or (first is not None and b.same(first)))
    return k.blocks


def signature_mismatch(f: Finding) -> list[Block]:
    cls, k = f.local_class(), Kept()
    if cls is None:
        return []
    local, own = f.local(), class_parts(f, [cls])
    parents = f.program.parents(cls.name)
    above = [b for b in class_parts(f, parents) if not b.within(cls)]
    names = {b.name for b in own if is_method(b)}
    for p in parents:
        has = {b.name for b in above if is_method(b) and b.owner == p.name}
        for name in sorted(names - has) if has else ():
            found = f.program.function_by_mro(name, p.name)
            if found is not None and not any(found.same(b) for b in above):
                above.append(found)
    order = f.program.mro(cls.name)
    nearest: dict[str, str] = {}
    for b in above:
        if is_method(b) and b.owner in order and (b.name not in nearest or order.index(b.owner) < order.index(nearest[b.name])):
            nearest[b.name] = b.owner
    for b in own:
        k.add(b, b.same(local) or (is_method(b) and b.name in nearest))
    for b in above:
        k.add(b, is_method(b) and b.name in names and nearest.get(b.name) == b.owner)
    return k.blocks


def conflicting_attributes(f: Finding) -> list[Block]:
    local, k = f.local(), Kept()
    k.add(local, True)
    cls = f.local_class()
    parents = f.program.parents(cls.name) if cls else []
    for b in class_parts(f, parents):
        k.add(b)
    attrs = [m[0].strip() for m in (re.findall(r"'(.*)':", x) for x in f.message.split("\n")) if m]
    for p in parents:
        for a in attrs:
            k.add(f.program.function_by_mro(a, p.name), True)
    methods: dict[str, int] = {}
    for b in k.blocks:
        if is_method(b):
            methods[b.name] = methods.get(b.name, 0) + 1

    def chosen(b: Block) -> bool:
        if is_method(b):
            return b.name == "__init__" or (methods[b.name] > 1 and b.name != "process_request")
        return any(a in f.program.text[i] for i in b.others for a in attrs)

    k.mark(chosen)
    return k.blocks


def equality_and_hash(f: Finding) -> list[Block]:
    cls, k = f.local_class(), Kept()
    missing = f.message.split()[-1].split(".")[0].strip()
    present = "__hash__" if missing == "__eq__" else "__eq__"
    if cls is None:
        return []
    for b in class_parts(f, [cls]):
        k.add(b, b.same(f.local()) or is_method(b, present))
    k.add(f.program.function_by_mro(missing, cls.name), True)
    return k.blocks


def flask_debug(f: Finding) -> list[Block]:
    from .lexer import tokens

    found = tokens(f.program.source)
    names = [t.text for t in found]
    at = next((t.sl for i, t in enumerate(found) if names[i : i + 4] == ["Flask", "(", "__name__", ")"]), None)
    k = Kept()
    for b in f.program.blocks:
        lines = set(b.lines())
        if at in lines or {f.start, f.end} <= lines:
            k.add(b, True)
    k.add(f.local(), True)
    return k.blocks


def class_instantiation(f: Finding) -> list[Block]:
    k = Kept()
    k.add(f.local(), True)
    places = LOCATION.findall(f.message)
    if len(places) != 1:
        return k.blocks
    # lines of the message are 1-based and are compared as they are
    first, last = int(places[0][0]), int(places[0][2])
    cls = next((c for c in f.program.classes if c.start <= first and c.end >= last), None)
    if cls is None:
        raise ValueError("no __init__ in class")
    for b in class_parts(f, [cls]):
        k.add(b, is_method(b, "__init__"))
    return k.blocks


def incomplete_ordering(f: Finding) -> list[Block]:
    cls, k = f.local_class(), Kept()
    if cls is None:
        return []
    own = class_parts(f, [cls])
    for b in own:
        k.add(b, b.same(f.local()))
    for name in ORDERING:
        if not any(is_method(b, name) for b in own):
            k.add(f.program.function_by_mro(name, cls.name))
    k.mark(lambda b: is_method(b, *ORDERING))
    return k.blocks


def missing_init_call(f: Finding) -> list[Block]:
    cls, k = f.local_class(), Kept()
    if cls is None:
        return []
    for b in class_parts(f, [cls, *f.program.parents(cls.name)]):
        if is_method(b, "__init__") or (b.within(cls) and b.same(f.local())):
            k.add(b, True)
    return k.blocks


def iterator_result(f: Finding) -> list[Block]:
    word, target, *_ = f.message.split()
    if word != "Class":
        raise ValueError("the message names no class")
    cls, k = f.local_class(), Kept()
    if cls is None:
        return []
    for b in f.program.blocks:
        if b.within(cls) and (b.same(f.local()) or is_method(b, "__iter__")):
            k.add(b, True)
        elif is_method(b, "__iter__") and f"return {target}" in " ".join(b.content.split()):
            k.add(b, True)
    return k.blocks


# Names of queries and of auxiliary results.
RULES: dict[str, Callable[[Finding], list[Block]]] = {
    "Unused import": unused_import,
    "`__eq__` not overridden when adding attributes": equals_with_attributes,
    "Use of the return value of a procedure": _called("Used function call map"),
    "Wrong number of arguments in a call": _called("Function call map"),
    "Comparison using is when operands support `__eq__`": _typed("__eq__", EQ_STUB, True),
    "Non-callable called": _typed("__call__", CALL_STUB, False),
    "`__init__` method calls overridden method": init_calls_overridden,
    "Signature mismatch in overriding method": signature_mismatch,
    "Conflicting attributes in base classes": conflicting_attributes,
    "Inconsistent equality and hashing": equality_and_hash,
    "Flask app is run in debug mode": flask_debug,
    "Wrong number of arguments in a class instantiation": class_instantiation,
    "Incomplete ordering": incomplete_ordering,
    "Missing call to `__init__` during object initialization": missing_init_call,
    "`__iter__` method returns a non-iterator": iterator_result,
}


def context(query: str, f: Finding) -> tuple[list[Block], str]:
    """(blocks, "") or ([], reason)."""
    try:
        found = RULES.get(query, distributable)(f)
    except Exception as e:  # a rule that fails rejects its finding, not the run
        return [], f"generic: {e}"
    if not found:
        return [], "empty context"
    if not any(b.relevant for b in found):
        return [], "no relevant block"
    return found, ""


# Queries whose supporting facts add no block, and those whose facts stand for themselves.
WITHOUT_FACTS = (
    "`__eq__` not overridden when adding attributes",
    "Special method has incorrect signature",
    "Non-standard exception raised in special method",
    "Should use a 'with' statement",
    "Modification of parameter with default",
)
PLAIN_FACTS = ("Variable defined multiple times", "Module is imported more than once")


def with_facts(query: str, f: Finding, blocks: list[Block], facts: list[tuple[int, int]]) -> list[Block]:
    """Context with the blocks that hold the supporting facts (first and last line of each).

    A block that is there becomes relevant; another is added, with what links
    its class to the finding's.
    """
    if query in WITHOUT_FACTS:
        return blocks
    out = list(blocks)

    def join(block: Block) -> None:
        for i, b in enumerate(out):
            if b.placed(block):
                out[i] = replace(b, relevant=True)
                return
        out.append(replace(block, relevant=True))

    held: list[Block] = []
    for start, end in facts:
        b = f.program.local_block(start, end)
        if b is None:
            raise ValueError("a supporting fact in no block")
        if not any(b.same(h) for h in held):
            held.append(b)
    for b in held:
        there = any(b.placed(x) for x in out)
        for x in [b] if there or query in PLAIN_FACTS else linked(f, b):
            join(x)
    return out


def linked(f: Finding, fact: Block) -> list[Block]:
    """A fact's block, and the fields and ``__init__`` of the classes between it and the finding, in the file's order."""
    in_class = ("CLASS_FUNCTION", "CLASS_OTHER")
    if fact.kind not in in_class:
        return [fact]
    own, local, cls = f.program.local_class(fact.start, fact.end), f.local(), f.local_class()
    if own is None:
        raise ValueError("a supporting fact in no class")
    if local is not None and local.kind in in_class and cls is not None:
        names = between_classes(f.program.mro(cls.name), f.program.mro(own.name))
        if not names:
            return [fact]
        candidates = f.program.blocks
    else:
        names = [own.name]
        candidates = [b for b in f.program.blocks if b.within(own)]
    return [b for b in candidates if b.placed(fact) or (is_method(b, "__init__") and b.owner in names) or (b.kind == "CLASS_OTHER" and b.name in names)]


def between_classes(a: list[str], b: list[str]) -> list[str]:
    """The classes from one to the other, the lower first, if one comes from the other; orders begin with the class itself."""
    if b[0] in a and a[0] not in b:
        return between(a, b[0])
    if a[0] in b and b[0] not in a:
        return between(b, a[0])
    return []


def with_all_blocks(blocks: list[Block], program: Program) -> list[Block]:
    """Simplified relevance: all of the context is relevant, every other block of the file follows as irrelevant."""
    k = Kept()
    for b in blocks:
        k.add(b, True)
    for b in program.blocks:
        if not any(b.lines() == x.lines() for x in k.blocks):
            k.add(b)
    return k.blocks
