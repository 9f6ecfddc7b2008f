"""Cutting of lineage: a plan's result as a table in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.  Where it is unset: a temporary folder in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "spanloom-checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, parts: int = 0) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: the plan is cut and a lost executor costs no recomputation.

    Its shuffles have ``parts`` partitions, if the session has fewer.
    """
    spark = df.sparkSession
    path, key = new_path(spark, name), "spark.sql.shuffle.partitions"
    usual = spark.conf.get(key)
    if parts > int(usual):
        spark.conf.set(key, str(parts))
    try:
        df.write.parquet(path)
    finally:
        if parts > int(usual):
            spark.conf.set(key, usual)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``df``, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
