"""Text functions on columns.  Python's ``strip`` takes all white space, SQL's ``trim`` spaces alone; names say which is meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators, the mark for no span, layout tokens, places in messages.
#: Between the spans of one text, and what stands where there is none.
SPAN_SEPARATOR, NO_SPAN = ":::-:::", "N/A"
#: Between the parts of an analysis message.
MESSAGE_SEPARATOR = ":::"
#: Layout tokens of the lexer.
LAYOUT = r"^___(NL|NEWLINE|DEDENT|INDENT)___"


def sanitized(text: Column) -> Column:
    """Lines that aren't empty, each closed by a newline (one newline if there is none)."""
    return F.concat(F.array_join(F.filter(F.split(text, "\n"), lambda x: x != ""), "\n"), F.lit("\n"))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Runs of other than white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def pieces(text: Column) -> Column:
    """Split at each single space; neighbouring spaces leave empty pieces."""
    return F.split(text, " ")


def piece_ends(text: Column) -> Column:
    """The end (exclusive) of each of the ``pieces``: the places of the spaces, and the end of the text.  One pass over the characters."""
    spaces = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c == " ", i)), lambda i: i.isNotNull())
    return F.concat(spaces, F.array(F.length(text)))


def joined_spans(spans: Column) -> Column:
    """Spans as one text, or the mark for none."""
    return F.when(F.size(spans) > 0, F.array_join(spans, SPAN_SEPARATOR)).otherwise(NO_SPAN)


def split_spans(text: Column) -> Column:
    return F.when(text == NO_SPAN, F.array().cast("array<string>")).otherwise(F.split(text, SPAN_SEPARATOR))


def split_generation(text: Column) -> tuple[Column, Column]:
    """Answer and supporting facts of a generation; the second is null where the heading is missing."""
    heading = "Supporting fact span(s)\n```python"
    parts = F.split(text, "\\Q" + heading + "\\E", 2)
    bare = lambda x: stripped(F.regexp_replace(stripped(x), r"^```(python)?|```$", ""))
    return bare(parts[0]), F.when(F.size(parts) == 2, bare(F.get(parts, F.lit(1))))


def metadata(content: Column, language: str = "python") -> Column:
    """Map of ``@key value`` pairs from the comment before ``import <language>``; of equal keys the last counts."""
    head = F.split(content, rf"import {language}")[0]
    trimmed = F.regexp_replace(stripped(head), r"^/+|/+$", "")
    lines = F.transform(F.split(trimmed, "\n"), lambda x: stripped(F.regexp_replace(stripped(x), r"^\*+", "")))
    parts = F.slice(F.split(F.array_join(lines, " "), "@"), 2, 1_000_000)
    clean = F.filter(F.transform(parts, lambda x: stripped(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    pairs = F.transform(clean, lambda x: F.struct(F.substring_index(x, " ", 1).alias("key"), F.when(F.instr(x, " ") > 0, F.substring(x, F.instr(x, " ") + 1, F.length(x))).otherwise("").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, 1_000_000), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


LOCATION = r"relative:///[a-zA-Z0-9_.]*:(\d+):(\d+):(\d+):(\d+)"


def locations(message: Column) -> Column:
    """Array of struct sl, sc, el, ec, as written in the message (1-based).  Paths with other characters don't match."""
    parts = [F.transform(F.regexp_extract_all(message, F.lit(LOCATION), F.lit(i)), lambda x: x.cast("int")) for i in (1, 2, 3, 4)]
    return F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("a", "b", "c", "d"), strict=True))), lambda x: F.struct(x["a"].alias("sl"), x["b"].alias("sc"), x["c"].alias("el"), x["d"].alias("ec")))


def called_function(message: Column) -> Column:
    """Qualified name between the first ``[[`` and the last ``|`` of a call-map message, without quotes."""
    return F.regexp_replace(F.regexp_extract(message, r"\[\[(.*)\|", 1), r'^"+|"+$', "")


def conflicting_attributes(message: Column) -> Column:
    """Quoted name before a colon, by line; empty where a line has none."""
    return F.transform(F.split(message, "\n"), lambda x: F.regexp_extract(x, "'(.*)':", 1))


def target_class(message: Column) -> Column:
    """struct<kind, name> of the first part of a message: class, builtin or import."""
    first = stripped(F.split(message, MESSAGE_SEPARATOR)[0])
    name = F.element_at(F.split(first, " "), -1)
    kind = F.when(first.startswith("class "), "class").when(first.startswith("builtin-class "), "builtin").otherwise("import")
    return F.struct(kind.alias("kind"), F.when(kind != "import", name).alias("name"))


def last_segment(path: Column, back: int = 1) -> Column:
    """The last part of a dotted name, or the one ``back`` from the end; null beyond its start."""
    return F.try_element_at(F.split(path, r"\."), F.lit(-back))


def import_lines(statement: Column) -> Column:
    """``import a, b`` and ``from m import a, b`` as one statement for each name."""
    head = F.regexp_extract(statement, r"^\s*(from\s+\S+\s+import|import)\s", 1)
    rest = F.regexp_replace(F.regexp_replace(statement, r"^\s*(from\s+\S+\s+import|import)\s+", ""), r"[()\n\\]", " ")
    names = F.filter(F.transform(F.split(rest, ","), lambda x: stripped(x)), lambda x: x != "")
    return F.transform(names, lambda n: F.concat(F.regexp_replace(head, r"\s+", " "), F.lit(" "), n))


def class_bases(header: Column) -> Column:
    """Names between the last ``(`` and ``):`` of a class header; keyword arguments count as bases."""
    inner = F.regexp_extract(F.element_at(F.split(header, r"\("), -1), r"^(.*)\)\s*:", 1)
    return F.when(F.instr(header, "(") > 0, F.filter(F.transform(F.split(inner, ","), lambda x: stripped(x)), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def file_name(path: Column) -> Column:
    return F.translate(path, "/", "_")


def report_name(prefix: Column, setting: Column, query: Column) -> Column:
    """A short name for a result file: parts joined by underscores, the query cut to five letters."""
    return F.concat_ws("_", prefix, setting, F.substring(query, 1, 5))


def truncated_prompt(prompt: Column, tokens: Column, most: int = 4096, keep: int = 3000) -> Column:
    return F.when(tokens > most, F.substring(prompt, 1, keep)).otherwise(prompt)


def is_layout(token: Column) -> Column:
    return token.rlike(LAYOUT)
