"""What the operators of this subpackage share: cutting of lineage, Arrow batch sizes and small text helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import discard, materialize

__all__ = ["crc_mod", "discard", "map_arrow", "materialize", "read_table", "texts_of", "tune", "width"]

#: Rows and bytes of one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, unless it has smaller ones."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        try:
            now = int(spark.conf.get(key))
        except Exception:  # the setting is absent or has a unit: ours is put in its place
            now = 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    tune(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(df: DataFrame) -> int:
    """Shuffle partitions of the session: a multiple of the cluster's cores by its operator's choice."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(doc_id: str, by: int):
    """crc32 of the decimal text of ``doc_id``, modulo ``by``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by
