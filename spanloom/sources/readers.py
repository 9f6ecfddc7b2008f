"""Scans of the engine's inputs: programs, query catalogue, analysis results, generation logs, examples, metadata.

A CSV with line breaks in its cells can't be split, so such a table is best
kept as several files; every scan takes a directory or a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators.relational import split_rejects

# Columns of the analysis results, which have no header.
RESULT_COLUMNS = ("name", "description", "severity", "message", "path", "start_line", "start_column", "end_line", "end_column")
# What the catalogue's marks for hops and spans mean.
HOPS = {"1": "single_hop", "k": "multiple_hops", None: "undefined_hop"}
SPANS = {"1": "single_span", "k": "multiple_spans", None: "undefined_span"}
# Fixed value: what stands for a missing part of a query's metadata.
MISSING = "NA"
CELLS = {"multiLine": True, "quote": '"', "escape": '"'}


def file_list(spark: SparkSession, list_path: str) -> DataFrame:
    """``path`` of each line of a list, without white space at its ends; blank lines are left out."""
    return spark.read.text(list_path).select(text.stripped(F.col("value")).alias("path")).filter("path <> ''")


def files(spark: SparkSession, listed: DataFrame, root: str) -> DataFrame:
    """path (relative to ``root``) and content of the listed files; those that aren't there are missing in the result."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^\\Q" + "/" + root.split(":")[-1].strip("/") + "/" + "\\E", "")
    return found.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content")).join(listed, "path", "left_semi")


def program_records(programs: DataFrame, dataset: str, split: str, language: str = "python", repository: str | None = None) -> DataFrame:
    """Records of programs (path, content): the path under a dataset's split, or under a repository; exactly one of both is set."""
    place = F.struct(F.lit(dataset).alias("source_name"), F.lit(split).alias("split"), F.col("path").alias("unique_file_path"))
    own = F.struct(F.lit(repository).alias("repo"), F.col("path").alias("unique_file_path"))
    null = F.lit(None)
    return programs.select(
        (null if repository else place).cast("struct<source_name:string,split:string,unique_file_path:string>").alias("dataset_path"),
        (own if repository else null).cast("struct<repo:string,unique_file_path:string>").alias("github_path"),
        F.lit(language).alias("language"),
        "content",
    )


def _meaning(mark: Column, names: dict) -> Column:
    return F.when(mark == "1", names["1"]).when(mark == "k", names["k"]).otherwise(names[None])


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The labelled list of queries (Path, Url, Description, Hops, Span): path, repo, url, hops, span.  Their content isn't fetched."""
    rows = spark.read.options(header=True, **CELLS).csv(path)
    owner = F.array_join(F.slice(F.split("Url", "/"), 4, 2), "/")
    return rows.select(F.col("Path").alias("path"), F.concat(F.lit("https://github.com/"), owner).alias("repo"), F.col("Url").alias("url"), _meaning(F.col("Hops"), HOPS).alias("hops"), _meaning(F.col("Span"), SPANS).alias("span"))


def query_records(queries: DataFrame, single_block_names: list[str], language: str = "python") -> DataFrame:
    """Records of queries (path, content, hops, span): parts of the header, ``NA`` where it has none, the id, and whether one block is enough.

    ``single_block_names`` lists the queries that need more than one block.
    """
    parts = queries.withColumn("parts", text.metadata(F.col("content"), language))
    get = lambda k: F.coalesce(F.try_element_at("parts", F.lit(k)), F.lit(MISSING))
    named = parts.select("path", "content", "hops", "span", get("name").alias("name"), get("description").alias("description"), get("problem.severity").alias("severity"))
    return named.select("*", ids.query_id(F.col("path"), F.col("content")).alias("query_id"), (~F.col("name").isin(single_block_names)).alias("distributable"))


def results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) of analysis: name, message, path without its leading slash, and the 0-based span; rejects lack a coordinate."""
    kinds = ", ".join(f"{c} {'double' if c.endswith(('line', 'column')) else 'string'}" for c in RESULT_COLUMNS)
    rows = spark.read.schema(kinds).options(**CELLS).csv(path).withColumn("path", F.substring("path", 2, 1 << 30))
    whole, rejects = split_rejects(rows, RESULT_COLUMNS[5:])
    at = lambda c, by: (F.col(c) - by).cast("int")
    span = F.struct(at("start_line", 1).alias("sl"), at("start_column", 1).alias("sc"), at("end_line", 1).alias("el"), at("end_column", 0).alias("ec"))
    return whole.select("name", "description", "severity", "message", "path", span.alias("span")), rejects


def auxiliary(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Auxiliary results as written (1-based, end column inclusive), of one kind or all."""
    kinds = ", ".join(f"{c} {'int' if c.endswith(('line', 'column')) else 'string'}" for c in RESULT_COLUMNS)
    rows = spark.read.schema(kinds).options(**CELLS).csv(path).withColumn("path", F.substring("path", 2, 1 << 30))
    rows = rows if name is None else rows.filter(F.col("name") == name)
    return rows.select("name", "message", "path", "start_line", F.col("start_column").alias("start_col"), "end_line", F.col("end_column").alias("end_col"))


def generations(spark: SparkSession, path: str, n: int = 10, facts: bool = False) -> DataFrame:
    """Log of generations, without a header: i, query, file_path, prompt, ans_spans, (sf_spans,) and ``generations``, an array of ``n``.  An empty cell is the empty text."""
    names = ["i", "query", "file_path", "prompt", "ans_spans", *(["sf_spans"] if facts else [])]
    answers = [f"ans_{k}" for k in range(n)]
    rows = spark.read.schema(", ".join(f"{c} string" for c in [*names, *answers])).options(**CELLS).csv(path)
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(F.col("i").cast("int").alias("i"), *(cell(c).alias(c) for c in names[1:]), F.array(*(cell(c) for c in answers)).alias("generations"))


def of_sign(log: DataFrame, kind: str) -> DataFrame:
    """Rows of a log with answer spans (positive), without (negative), or all."""
    has = F.col("ans_spans") != text.NO_SPAN
    return {"positive": log.filter(has), "negative": log.filter(~has)}.get(kind, log)


def examples(spark: SparkSession, path: str, config: str, split: str) -> DataFrame:
    """Rows of one configuration and split of a table parted by them; other parts aren't read."""
    return spark.read.parquet(path).filter((F.col("config") == config) & (F.col("split") == split)).drop("config", "split")


def recommendations(spark: SparkSession, path: str) -> DataFrame:
    """name, recommendation and description from a JSON document that maps names to both."""
    kind = "map<string,struct<recommendation:string,description:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("name", "x"))
    return rows.select("name", "x.recommendation", "x.description")


def splits(spark: SparkSession, path: str) -> DataFrame:
    """All splits of a dataset in one; they must hold examples of one type, else the query fails."""
    rows = spark.read.parquet(path)
    if "example_type" in rows.columns and len(types := rows.select("example_type").distinct().limit(2).collect()) > 1:
        raise ValueError(f"splits of different types of examples: {sorted(r[0] for r in types)}")
    return rows
