"""Source files to tokens, blocks and contexts, by file in Arrow batches; and class hierarchies as edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import discard, materialize

BLOCK = "pos int, block_type string, start_line int, end_line int, other_lines array<int>, content string, metadata string, block_header string, mro array<string>, relevant boolean"


def _row(i, b):
    return (i, b.kind, b.start, b.end, list(b.others), b.content, b.metadata, b.header, list(b.mro), b.relevant)


NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def blocks(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """One row for each block of each file; a null source is an empty file."""
    from ..source_code.blocks import Program

    def run(batches):
        for pdf in batches:
            rows = [(p, *_row(i, b)) for p, s in zip(pdf["path"], pdf["source"], strict=True) for i, b in enumerate(Program(s or "").blocks)]
            yield pd.DataFrame(rows, columns=["path", *NAMES])

    return files.select(F.col(path).alias("path"), F.col(source).alias("source")).mapInPandas(run, f"path string, {BLOCK}")


def tokens(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """One row for each token of each program: path, pos, token text and its place."""
    from ..source_code.lexer import program_tokens

    def run(batches):
        for pdf in batches:
            rows = [(p, i, *t) for p, s in zip(pdf["path"], pdf["source"], strict=True) for i, t in enumerate(program_tokens(s or ""))]
            yield pd.DataFrame(rows, columns=["path", "pos", "text", "sl", "sc", "el", "ec"])

    flat = files.select(F.col(path).alias("path"), F.col(source).alias("source")).mapInPandas(run, "path string, pos int, text string, sl int, sc int, el int, ec int")
    return flat.select("path", "pos", "text", F.struct("sl", "sc", "el", "ec").alias("token"))


AUX = "array<struct<name:string,message:string,start_line:int,start_col:int,end_line:int,end_col:int>>"


def contexts(findings: DataFrame, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """(blocks, rejects) of findings: finding_id, query, source, message, span struct (0-based), aux, the auxiliary rows of the file (``AUX``), and, if there are any, ``facts``, an array of span structs."""
    from ..source_code import rules
    from ..source_code.blocks import Program

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                program = Program(r.source or "")
                aux = [rules.Aux(*(a[k] for k in ("name", "message", "start_line", "start_col", "end_line", "end_col"))) for a in (r.aux if r.aux is not None else [])]
                f = rules.Finding(program, r.sl, r.sc, r.el, r.ec, r.message or "", aux)
                found, why = rules.context(r.query, f)
                try:
                    if found and r.facts is not None:
                        found = rules.with_facts(r.query, f, found, [(x["sl"], x["el"]) for x in r.facts])
                except ValueError as e:
                    found, why = [], f"generic: {e}"
                if everything and not why:
                    found = rules.with_all_blocks(found, program)
                rows += [(r.finding_id, None, *_row(i, b)) for i, b in enumerate(found)] or [(r.finding_id, why, *[None] * len(NAMES))]
            yield pd.DataFrame(rows, columns=["finding_id", "error", *NAMES])

    facts = F.col("facts") if "facts" in findings.columns else F.lit(None).cast("array<struct<sl:int,sc:int,el:int,ec:int>>")
    flat = findings.select("finding_id", "query", "source", "message", "span.sl", "span.sc", "span.el", "span.ec", "aux", facts.alias("facts"))
    made = materialize(flat.mapInPandas(run, f"finding_id long, error string, {BLOCK}"), "contexts")  # both sides read it
    return made.filter("error IS NULL").drop("error"), made.filter("error IS NOT NULL").select("finding_id", F.lit("Context error").alias("error_type"), F.col("error").alias("message"))


def header_tokens(headers: DataFrame, keys: list[str], header: str = "block_header") -> DataFrame:
    """Tokens of blocks' headers, labelled outside and without a place: keys, pos, text, token."""
    return _tokenised(headers, keys, header, "header_tokens")


def stub_tokens(stubs: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Tokens of stubs: keys, pos, text, token."""
    return _tokenised(stubs, keys, content, "stub_tokens")


def query_tokens(queries: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Tokens of queries' names: keys, pos, text, token."""
    return _tokenised(queries, keys, name, "query_tokens")


def perturbed_tokens(lines: DataFrame, keys: list[str], code: str = "code", number: str = "line") -> DataFrame:
    """Tokens of changed lines, all on the given line, one behind the other; a line that can't be read fails the query."""
    found = _tokenised(lines, [*keys, number], code, "tokens")
    checked = F.when(F.col("text") == "___ERROR___", F.raise_error(F.lit("a changed line can't be read")).cast("string")).otherwise(F.col("text"))
    end = F.sum(F.length("text") + 1).over(Window.partitionBy(*keys, number).orderBy("pos")).cast("int")
    at = F.struct(F.col(number).alias("sl"), (end - 1 - F.length("text")).alias("sc"), F.col(number).alias("el"), (end - 2).alias("ec"))
    return found.withColumn("token", at).select(*keys, "pos", checked.alias("text"), "token")


def _tokenised(df: DataFrame, keys: list[str], column: str, how: str) -> DataFrame:
    from ..source_code import lexer

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            rows = [(*k, i, t.text, t.sl, t.sc, t.el, t.ec) for *k, x in pdf.itertuples(index=False) for i, t in enumerate(getattr(lexer, how)(x or ""))]
            yield pd.DataFrame(rows, columns=[*keys, "pos", "text", "sl", "sc", "el", "ec"])

    flat = df.select(*keys, F.col(column).alias("__text")).mapInPandas(run, f"{kinds}, pos int, text string, sl int, sc int, el int, ec int")
    return flat.select(*keys, "pos", "text", F.struct("sl", "sc", "el", "ec").alias("token"))


def orders(classes: DataFrame) -> DataFrame:
    """Method resolution order of each class: (hierarchy, cls, mro) from rows (hierarchy, cls, bases)."""
    from ..source_code.mro import linearized

    def run(pdf):
        bases = {c: list(b) for c, b in zip(pdf["cls"], pdf["bases"], strict=True)}
        return pd.DataFrame({"hierarchy": pdf["hierarchy"].iloc[0], "cls": list(bases), "mro": [linearized(bases, c) for c in bases]})

    return classes.groupBy("hierarchy").applyInPandas(run, "hierarchy string, cls string, mro array<string>")


def ancestors(edges: DataFrame) -> DataFrame:
    """(hierarchy, child, ancestor, steps): all pairs by any number of steps and the least of them, from edges (hierarchy, child, parent).

    Each round joins the pairs to themselves, so it doubles the steps; it ends
    when nothing is new.  In a cycle a class isn't its own ancestor, but by an edge to itself.
    """
    pairs = materialize(edges.select("hierarchy", "child", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")).distinct(), "ancestors")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum("steps")).first())
    was = mark(pairs)
    while was[0]:
        up = pairs.select("hierarchy", F.col("child").alias("ancestor"), F.col("ancestor").alias("above"), F.col("steps").alias("more"))
        longer = pairs.join(up, ["hierarchy", "ancestor"]).filter("child <> above").select("hierarchy", "child", F.col("above").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        used, pairs = pairs, materialize(pairs.union(longer).groupBy("hierarchy", "child", "ancestor").agg(F.min("steps").alias("steps")), "ancestors")
        discard(used)
        now = mark(pairs)
        if now == was:
            break
        was = now
    return pairs
