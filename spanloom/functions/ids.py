"""Identifiers by MD5 of concatenated parts (hexadecimal; ``unhex`` gives the 16 bytes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of block types and labels.
BLOCK_TYPES = {"CLASS_FUNCTION": 0, "CLASS_OTHER": 1, "MODULE_FUNCTION": 2, "MODULE_OTHER": 3, "STUB": 4}


def block_type_number(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in BLOCK_TYPES.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def md5_of(*parts: Column) -> Column:
    return F.md5(F.concat(*(p.cast("string") for p in parts)).cast("binary"))


def block_id(path: Column, body: Column, start: Column, end: Column, kind: Column) -> Column:
    """Of a block: 0-based lines as decimals and the number of its type."""
    return md5_of(path, body, start, end, kind)


def query_id(path: Column, content: Column) -> Column:
    return md5_of(path, content)


def group_id(query: Column, path: Column, block_ids: Column) -> Column:
    """Of a group of blocks, whatever their order."""
    return md5_of(query, path, F.array_join(F.array_sort(block_ids), ""))


def separator_id() -> Column:
    """The block id that separators carry."""
    return F.md5(F.lit("_").cast("binary"))
