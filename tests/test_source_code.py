"""Lexer, blocks, class orders and the sixteen context rules, on sources whose parts are known."""

import textwrap

import pytest

from spanloom.source_code import lexer, mro, rules
from spanloom.source_code.blocks import LEVEL, Program, import_lines, stub_blocks


def src(text):
    return textwrap.dedent(text).strip("\n")


SHOP = src("""
    import os
    from shop.base import Base


    class Item(object):
        kind = 'item'

        def __init__(self, name):
            self.name = name
            self.setup()

        def setup(self):
            pass

        def __eq__(self, other):
            return self.name == other.name

    class Book(Item):
        pages = 1

        def __init__(self, name, pages):
            self.pages = pages

        def setup(self, now):
            self.pages = now

        def __lt__(self, other):
            return self.pages < other.pages

        def __iter__(self):
            return self.pages

    class Both(Item, Base):
        def setup(self):
            return None

    def make(kind):
        return Book(kind, 3)

    result = make('x')
    print(result is Book('y', 2))
""")
LINES = SHOP.split("\n")


def line(text, nth=0):
    return [i for i, x in enumerate(LINES) if text in x][nth]


def run(query, at, message="", aux=(), program=SHOP, facts=()):
    """{block's path: relevant} in order, or the reason of a rejection."""
    f = rules.Finding(Program(program), at, 0, at, len(program.split("\n")[at]), message, list(aux))
    found, why = rules.context(query, f)
    if why:
        return why
    if facts:
        found = rules.with_facts(query, f, found, list(facts))
    return {b.metadata: b.relevant for b in found}


def test_tokens_have_places_and_layout():
    got = lexer.tokens("if x:\n    y = 'a\\tb'  # c\n")
    assert [t.text for t in got] == ["if", "x", ":", "___NEWLINE___", "___INDENT___", "y", "=", "'a\\tb'", "# c", "___NEWLINE___", "___DEDENT___", "___EOS___"]
    assert got[5][1:] == (1, 4, 1, 5) and got[7][1:] == (1, 8, 1, 14)
    assert lexer.program_tokens("x") == lexer.tokens("x")[:-1]
    assert [t.text for t in lexer.query_tokens("Unused import")] == ["Unused", "import", "___NEWLINE___"]


def test_broken_source_ends_in_an_error():
    for broken in ("x = (1,\n", "def f(:\n  '''", "if x:\n  a\n b\n"):
        texts = [t.text for t in lexer.tokens(broken)]
        assert texts[-2:] == ["___ERROR___", "___EOS___"]
    assert [t.text for t in lexer.tokens("print x\n")][:2] == ["print", "x"]


def test_tokens_without_places():
    assert {t[1:] for t in lexer.header_tokens("class A(B):")} == {(-1, -1, -1, -1)}
    assert [t[1:] for t in lexer.stub_tokens("a\nb")][2:3] == [(1, 1, 1, 1)]


def test_blocks_part_a_file():
    p = Program(SHOP)
    for i in range(len(LINES)):
        assert sum(i in b.lines() for b in p.blocks) == 1
    by = {b.metadata: b for b in p.blocks}
    assert by["root.Book.setup"].kind == "CLASS_FUNCTION" and by["root.Book.setup"].header == "class Book(Item):"
    assert by["root.Book.setup"].mro == ("__", "__class__", "Book", "Item")
    assert by["root.Book.setup"].content == "def setup(self, now):\n        self.pages = now"
    assert by["root.make"].kind == "MODULE_FUNCTION" and by["root.make"].mro == LEVEL
    assert by["root.Book"].kind == "CLASS_OTHER" and LINES[by["root.Book"].others[1]] == "    pages = 1"
    assert by["root"].kind == "MODULE_OTHER" and "import os" in by["root"].content and "print" in by["root"].content
    assert p.mro("Both") == ["Both", "Item", "object", "Base"]
    assert [c.name for c in p.parents("Book")] == ["Item"] and [c.name for c in p.children("Item")] == ["Book", "Both"]
    assert p.local_class(line("pages = 1"), line("pages = 1")).name == "Book"


def test_decorators_nesting_and_old_syntax():
    p = Program(src("""
        class A:
            @property
            def x(self):
                def inner():
                    return 1
                return inner
        if 1:
            class B:
                def m(self): return 2
        try:
            def late(): pass
        except E, e:
            print 'x'
    """))
    got = {b.metadata: (b.kind, b.start, b.end) for b in p.blocks}
    assert got["root.A.x"] == ("CLASS_FUNCTION", 1, 5) and "root.A.x.inner" not in got
    assert got["root.B.m"] == ("CLASS_FUNCTION", 8, 8) and got["root.late"] == ("MODULE_FUNCTION", 10, 10)
    assert [b.kind for b in Program("").blocks] == ["MODULE_OTHER"]


def test_imports_and_module():
    assert import_lines("import os, sys as s") == ["import os", "import sys as s"]
    assert import_lines("from  a.b import (c,\n   d as e)") == ["from a.b import c", "from a.b import d as e"]
    assert import_lines("x = 1") == []
    b = Program(SHOP).imports()
    assert b.content == "import os\nfrom shop.base import Base" and b.others == (0, 1) and b.kind == "IMPORT"
    m = Program(SHOP).module()
    assert (m.start, m.end, m.content) == (0, len(LINES) - 1, SHOP)


def test_class_orders():
    bases = {"D": ["B", "C"], "B": ["A"], "C": ["A"], "A": ["object"], "X": ["Y"], "Y": ["X"], "P": ["A", "B"], "E": ["D", "Outside"]}
    assert mro.linearized(bases, "D") == ["D", "B", "C", "A"]
    assert mro.linearized(bases, "X") == ["X"] and mro.linearized(bases, "P") == ["P"]  # a cycle, no consistent order
    assert mro.linearized(bases, "E") == ["E", "D", "B", "C", "A", "object", "Outside"]
    assert mro.between(["D", "B", "A"], "B") == ["D", "B"] and mro.between(["D"], "B") == []


def test_stubs():
    got = [(b.kind, b.header, b.content, b.start, b.others) for b in stub_blocks("list", "__len__")]
    assert got == [("STUB", "STUB class list(object):", "def __len__(self):\n        raise NotImplementedError", -1, ()), ("STUB", "STUB module", "class list(object):", -1, (0,))]


def test_distributable_rule():
    assert run("Redundant assignment", line("self.pages = now")) == {"root.Book.setup": True}


def test_unused_import():
    used = rules.Aux("Used import", "", line("print(") + 1, 1, line("print(") + 1, 3)
    got = run("Unused import", 0, aux=[used, rules.Aux("Other", "", line("pass") + 1, 1, line("pass") + 1, 3)])
    assert got["root"] and sum(got.values()) == 1 and len(got) == len(Program(SHOP).blocks)
    more = run("Unused import", 0, aux=[rules.Aux("Used import", "", line("return Book") + 1, 1, line("return Book") + 1, 3)])
    assert more["root.make"] and more["root"]


def test_equality_and_attributes():
    got = run("`__eq__` not overridden when adding attributes", line("class Book"))
    assert got["root.Item.__eq__"] and got["root.Book.__init__"] and got["root.Item.__init__"] and got["root.Book"]
    assert not got["root.Book.setup"] and "root.make" not in got and "root" not in got


def test_call_rules():
    at = line("return Book")
    called = lambda name, kind: rules.Aux(kind, f"'[[\"{name}\"|\"relative:///s.py:1:1:1:1\"]]' is called", at + 1, 1, at + 1, len(LINES[at]))
    for query, kind in (("Use of the return value of a procedure", "Used function call map"), ("Wrong number of arguments in a call", "Function call map")):
        assert run(query, at, aux=[called("Book.__init__", kind), called("Item.setup", "Another kind")]) == {"root.make": True, "root.Book.__init__": True}
        elsewhere = rules.Aux(kind, "[[\"Book.setup\"|", at + 1, 5, at + 1, 9)  # in the block, but not the finding's call
        assert run(query, at, aux=[elsewhere]) == {"root.make": True, "root.Book.setup": False}


def test_comparison_and_call_of_types():
    at = line("print(")
    got = run("Comparison using is when operands support `__eq__`", at, "class Book:::a\nbuiltin-class list:::b")
    assert got["root"] and got["root.Item.__eq__"] and not got["root.Book.setup"] and got["root.list.__eq__"] and not got["root.list"]
    assert run("Comparison using is when operands support `__eq__`", at, "no type") == {"root": True}
    call = run("Non-callable called", line("return Book"), "builtin-class list:::Call to a [[x]].")
    assert call == {"root.make": True, "root.list.__call__": True, "root.list": False}
    assert run("Non-callable called", line("return Book"), "builtin-class module:::Call") == {"root.make": True, "root": True}


def test_init_calls_overridden():
    got = run("`__init__` method calls overridden method", line("self.setup()"))
    assert got["root.Item.__init__"] and got["root.Book.setup"] and got["root.Both.setup"]
    assert not got["root.Book.__init__"] and not got["root.Item.setup"]


def test_signature_mismatch():
    got = run("Signature mismatch in overriding method", line("def setup(self, now)"))
    assert got["root.Book.setup"] and got["root.Item.setup"] and got["root.Item.__init__"] and not got["root.Book.__lt__"]


def test_conflicting_attributes():
    got = run("Conflicting attributes in base classes", line("class Both"), "Base classes have conflicting values for attribute 'setup': [[x]] and\n'kind': y")
    assert got["root.Both"] and got["root.Item.setup"] and got["root.Item.__init__"] and got["root.Item"]


def test_equality_and_hash():
    got = run("Inconsistent equality and hashing", line("class Item"), "Class Item implements __eq__ but does not define __hash__.")
    assert got["root.Item.__eq__"] and got["root.Item"] and not got["root.Item.setup"]


def test_flask_debug():
    app = "from flask import Flask\n\napp = Flask(__name__)\n\ndef start():\n    app.run(debug=True)\n\ndef other():\n    pass\n"
    assert run("Flask app is run in debug mode", 5, program=app) == {"root.start": True, "root": True}


def test_class_instantiation():
    a, b = line("class Book") + 1, line("class Both") - 2
    got = run("Wrong number of arguments in a class instantiation", line("return Book"), f"[[Book|relative:///shop.py:{a + 1}:1:{b}:5]]")
    assert got["root.make"] and got["root.Book.__init__"] and not got["root.Book.setup"]
    assert run("Wrong number of arguments in a class instantiation", line("return Book"), "no place") == {"root.make": True}
    assert run("Wrong number of arguments in a class instantiation", 0, "relative:///shop.py:900:1:901:5").startswith("generic")


def test_incomplete_ordering():
    got = run("Incomplete ordering", line("class Book"))
    assert got["root.Book"] and got["root.Book.__lt__"] and not got["root.Book.setup"]


def test_missing_init_call():
    assert run("Missing call to `__init__` during object initialization", line("class Book")) == {"root.Item.__init__": True, "root.Book.__init__": True, "root.Book": True}


def test_iterator_result():
    assert run("`__iter__` method returns a non-iterator", line("class Book"), "Class Book is returned as an iterator") == {"root.Book.__iter__": True, "root.Book": True}
    assert run("`__iter__` method returns a non-iterator", line("class Book"), "nothing is named").startswith("generic")


def test_rejections():
    assert run("Incomplete ordering", line("result =")) == "empty context"
    assert set(rules.RULES) and len(rules.RULES) == 15


def test_facts_are_joined_to_the_context():
    query, at = "Redundant assignment", line("self.pages = now")
    assert run(query, at, facts=[(at, at)]) == {"root.Book.setup": True}
    upper = run(query, at, facts=[(line("pass"), line("pass"))])  # of a class above: what links both
    assert upper == {"root.Book.setup": True, "root.Item.__init__": True, "root.Item.setup": True, "root.Book.__init__": True, "root.Item": True, "root.Book": True}
    assert run(query, at, facts=[(line("result ="), line("result ="))]) == {"root.Book.setup": True, "root": True}
    module = run(query, line("result ="), facts=[(line("pages = 1"), line("pages = 1"))])
    assert module == {"root": True, "root.Book.__init__": True, "root.Book": True}
    assert run("Module is imported more than once", at, facts=[(line("pass"), line("pass"))]) == {"root.Book.setup": True, "root.Item.setup": True}
    assert run(rules.WITHOUT_FACTS[0], line("class Book"), facts=[(line("result ="), line("result ="))]).get("root") is None
    with pytest.raises(ValueError):
        run(query, at, facts=[(900, 900)])


def test_all_blocks_follow():
    p = Program(SHOP)
    f = rules.Finding(p, line("pass"), 0, line("pass"), 4)
    got = rules.with_all_blocks(rules.context("Redundant assignment", f)[0], p)
    assert len(got) == len(p.blocks) and [b.relevant for b in got] == [True] + [False] * (len(got) - 1)


def test_the_query_s_findings():
    """Contexts of the registered query's findings, relevant blocks with a star."""
    from spanloom.plans import code

    got = {}
    for i, query, path, message, span, aux in code.FINDINGS:
        f = rules.Finding(Program(code.FILES[path]), *span, message, [rules.Aux(*a) for a in aux])
        found, why = rules.context(query, f)
        got[i] = why or " ".join(b.metadata.removeprefix("root.") + "*" * b.relevant for b in found)
    assert got == {
        1: "Shape.__init__ Shape.setup Shape.__eq__ Square.__init__ Square.setup Square.area make Shape Square root*",
        2: "Shape.__init__* Shape.setup Shape.__eq__* Square.__init__* Square.setup Square.area Shape Square*",
        3: "Square.__init__ Square.setup* Square.area Square Shape.__init__* Shape.setup Shape.__eq__ Shape",
        4: "Shape.__init__* Square.__init__* Square*",
        5: "root* Square.__init__ Square.setup Square.area Square Shape.__eq__*",
        6: "root*",
        7: "make* Square.__init__* Square.setup Square.area Square",
        8: "f*",
        9: "Shape.__init__ Shape.setup Shape.__eq__* Shape",
        10: "generic: the message names no class",
        11: "root* make*",
        12: "make* Square.__init__*",
        13: "make* list.__call__* list",
        14: "Square.__init__* Square.setup* Square.area Square Shape.__init__* Shape.setup* Shape.__eq__ Shape",
        15: "Square* Shape.__init__* Shape.setup* Shape.__eq__ Shape",
        16: "Square.__init__ Square.setup Square.area Square*",
    }
