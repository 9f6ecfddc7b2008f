"""Sinks: splits, CSV tables, prompt files, logs of rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..operators.relational import contiguous_splits


def splits(df: DataFrame, path: str, key: str, k: int) -> None:
    """``k`` splits of neighbouring rows by ``key``, a folder ``split_id=i`` each (from 1)."""
    contiguous_splits(df, key, k).drop("idx").write.partitionBy("split_id").parquet(path)


def csv(df: DataFrame, path: str, mode: str = "append", header: bool = False) -> None:
    """Cells as they are: white space at their ends stays (Spark cuts it off unless told)."""
    df.write.mode(mode).options(header=header, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def prompt_files(df: DataFrame, path: str, name: str, text: str, separator: str = "\x00") -> None:
    """A folder for each row, named after ``name`` with underscores for slashes, with its text as one file."""
    df.select(file_name(F.col(name)).alias("file"), F.col(text).alias("value")).write.partitionBy("file").option("lineSep", separator).text(path)


def rejects(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rejected rows as JSON lines: error_type first, then what the row holds."""
    rest = [c for c in df.columns if c != "error_type"]
    df.select("error_type", *rest).write.mode(mode).json(path)


def examples(df: DataFrame, path: str, config: str = "config", split: str = "split") -> None:
    """Examples parted by configuration and split."""
    df.write.partitionBy(config, split).parquet(path)
