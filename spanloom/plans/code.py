"""Source files, class hierarchies and messages.

The driver's tables hold no source code: files are literals, and ``pages`` and
``events`` stand for messages and headers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import source
from .tables import read

FILES = {
    "shapes.py": '''import os
import sys as system

LIMIT = 3


class Shape(object):
    """A shape."""
    sides = 0

    def __init__(self, name):
        self.name = name
        self.setup()

    def setup(self):
        pass

    def __eq__(self, other):
        return self.name == other.name


class Square(Shape):
    sides = 4

    def __init__(self, name, size):
        self.size = size

    def setup(self):
        self.size = 0

    @property
    def area(self):
        return self.size ** 2


def make(kind):
    if kind == "square":
        return Square("s", 2)
    return Shape(kind)

print(os.name, make("square") is Square("s", 2))
''',
    "app.py": '''from flask import Flask

app = Flask(__name__)

try:
    def handler():
        return "ok"
except ImportError:
    handler = None

if __name__ == "__main__":
    app.run(debug=True)
''',
    "old.py": "def f(x):\n    print x, `x`\n    exec 'x' in {}\n\nclass K:\n    def m(self): return 1\n",
    "empty.py": "",
}
FINDINGS = [
    (1, "Unused import", "shapes.py", "", (1, 0, 1, 20), [("Used import", "Global Variable os ::: is used.", 41, 7, 41, 9)]),
    (2, "`__eq__` not overridden when adding attributes", "shapes.py", "", (21, 0, 21, 19), []),
    (3, "`__init__` method calls overridden method", "shapes.py", "", (12, 8, 12, 20), []),
    (4, "Missing call to `__init__` during object initialization", "shapes.py", "", (21, 0, 21, 19), []),
    (5, "Comparison using is when operands support `__eq__`", "shapes.py", "class Square:::is", (40, 15, 40, 50), []),
    (6, "Flask app is run in debug mode", "app.py", "", (11, 4, 11, 23), []),
    (7, "Wrong number of arguments in a class instantiation", "shapes.py", "relative:///shapes.py:22:1:32:25", (37, 15, 37, 31), []),
    (8, "Redundant assignment", "old.py", "", (1, 4, 1, 9), []),
    (9, "Inconsistent equality and hashing", "shapes.py", "implements __eq__ but not __hash__.", (17, 4, 18, 39), []),
    (10, "`__iter__` method returns a non-iterator", "shapes.py", "no class here", (0, 0, 0, 3), []),
    (11, "Use of the return value of a procedure", "shapes.py", "", (40, 15, 40, 29), [("Used function call map", '[["make"|"relative:///shapes.py:36:1:39:25"]]', 41, 16, 41, 29)]),
    (12, "Wrong number of arguments in a call", "shapes.py", "", (37, 15, 37, 31), [("Function call map", '[["Square.__init__"|"relative:///shapes.py:25:5:26:24"]]', 38, 16, 38, 31)]),
    (13, "Non-callable called", "shapes.py", "builtin-class list:::Call to a [[x]].", (37, 15, 37, 31), []),
    (14, "Signature mismatch in overriding method", "shapes.py", "", (27, 4, 28, 21), []),
    (15, "Conflicting attributes in base classes", "shapes.py", "'setup': in both", (21, 0, 21, 19), []),
    (16, "Incomplete ordering", "shapes.py", "", (21, 0, 21, 19), []),
]
HIERARCHY = [("g", "D", ["B", "C"]), ("g", "B", ["A"]), ("g", "C", ["A"]), ("g", "A", []), ("g", "E", ["D", "Outside"]), ("c", "X", ["Y"]), ("c", "Y", ["X"]), ("o", "P", ["object"])]


def _files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, source string")


def code_blocks(spark, sf_dir):
    got = source.blocks(_files(spark))
    return got.select("path", "pos", "block_type", "start_line", "end_line", F.array_join("other_lines", ",").alias("other_lines"), "metadata", "block_header", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def code_tokens(spark, sf_dir):
    return source.tokens(_files(spark)).select("path", "pos", "text", "token.*")


def context_rules(spark, sf_dir):
    rows = [(i, q, FILES[p], m, span, [dict(zip(("name", "message", "start_line", "start_col", "end_line", "end_col"), a, strict=True)) for a in aux]) for i, q, p, m, span, aux in FINDINGS]
    findings = spark.createDataFrame(rows, f"finding_id long, query string, source string, message string, span struct<sl:int,sc:int,el:int,ec:int>, aux {source.AUX}")
    kept, rejects = source.contexts(findings)
    return kept.select("finding_id", "pos", "block_type", "metadata", "relevant", F.lit("").alias("error")).unionByName(rejects.select("finding_id", F.lit(-1).alias("pos"), F.lit("").alias("block_type"), F.lit("").alias("metadata"), F.lit(False).alias("relevant"), F.col("message").alias("error")))


def mro_c3(spark, sf_dir):
    got = source.orders(spark.createDataFrame(HIERARCHY, "hierarchy string, cls string, bases array<string>"))
    return got.select("hierarchy", "cls", F.array_join("mro", ",").alias("mro"))


def transitive_closure(spark, sf_dir):
    """Which nation, region and world a customer's, supplier's nation lies in: all pairs of the hierarchy of places."""
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    edges = nations.select(F.lit("places").alias("hierarchy"), F.col("n_name").alias("child"), F.col("r_name").alias("parent")).unionByName(read(spark, sf_dir, "region").select(F.lit("places").alias("hierarchy"), F.col("r_name").alias("child"), F.lit("WORLD").alias("parent")))
    return source.ancestors(edges)


def location_regex_extract(spark, sf_dir):
    """Places in messages made of line items: none, one or two, beside one in a folder, which isn't one."""
    lines = read(spark, sf_dir, "lineitem")
    n = lambda c: F.col(c).cast("long").cast("string")
    place = lambda *cs: F.concat_ws(":", F.concat(F.lit("relative:///f_"), n("l_linenumber"), F.lit(".py")), *(n(c) for c in cs))
    one = F.concat(F.lit('see [["m.'), n("l_suppkey"), F.lit('"|"'), place("l_quantity", "l_linenumber", "l_partkey", "l_suppkey"), F.lit('"]] and relative:///a/b.py:1:2:3:4'))
    many = F.col("l_orderkey") % 3
    message = F.when(many == 0, "nothing is named").when(many == 1, one).otherwise(F.concat(one, F.lit(" or "), place("l_linenumber", "l_suppkey", "l_quantity", "l_partkey")))
    found = lines.select("l_orderkey", "l_linenumber", text.locations(message).alias("x"), text.called_function(message).alias("called"))
    return found.select("l_orderkey", "l_linenumber", "called", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["sl"], s["sc"], s["el"], s["ec"])), ";").alias("places"))


def metadata_kv_parse(spark, sf_dir):
    """Query headers made of documents: name, kind and a value of several words."""
    docs = read(spark, sf_dir, "documents")
    header = F.concat(F.lit("/**\n * @name "), F.col("source"), F.lit(" x  y\n * @kind "), F.col("lang"), F.lit("\n * @id\n * @kind late "), F.col("doc_id").cast("string"), F.lit("\n */\nimport python\nfrom x"))
    m = text.metadata(header)
    get = lambda k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("NA"))
    return docs.select("doc_id", get("name").alias("name"), get("kind").alias("kind"), get("id").alias("id"), get("severity").alias("severity"))


def props_parse(spark, sf_dir):
    """Events' JSON properties."""
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def page_paths(spark, sf_dir):
    """Names of files and dotted parts from pages' addresses."""
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", text.file_name(url).alias("file_name"), text.last_segment(url).alias("last_part"), text.last_segment(url, 2).alias("part_before"), F.coalesce(F.element_at(text.class_bases(F.concat(F.lit("class A(B, "), F.col("page_id").cast("string"), F.lit("):"))), -1), F.lit("")).alias("base"))


QUERIES = {f.__name__: f for f in (code_blocks, code_tokens, context_rules, mro_c3, transitive_closure, location_regex_extract, metadata_kv_parse, props_parse, page_paths)}
ORACLE_SQL = {
    "transitive_closure": """
        WITH RECURSIVE e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region),
        up AS (SELECT child, parent AS ancestor, 1 AS steps FROM e UNION ALL SELECT u.child, e.parent, u.steps + 1 FROM up u JOIN e ON e.child = u.ancestor)
        SELECT 'places' AS hierarchy, child, ancestor, CAST(min(steps) AS INTEGER) AS steps FROM up GROUP BY ALL""",
    "location_regex_extract": """
        SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'm.' || l_suppkey END AS called,
          CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE CAST(l_quantity AS BIGINT) || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey END || CASE WHEN l_orderkey % 3 = 2 THEN ';' || l_linenumber || ':' || l_suppkey || ':' || CAST(l_quantity AS BIGINT) || ':' || l_partkey ELSE '' END AS places FROM lineitem""",
    "metadata_kv_parse": "SELECT doc_id, source || ' x y' AS name, 'late ' || doc_id AS kind, '' AS id, 'NA' AS severity FROM documents",
    "props_parse": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "page_paths": "SELECT page_id, replace(url, '/', '_') AS file_name, string_split(url, '.')[-1] AS last_part, string_split(url, '.')[-2] AS part_before, CAST(page_id AS VARCHAR) AS base FROM pages",
}
