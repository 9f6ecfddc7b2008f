"""Round trips through every format: tables are written to the shared folder and scanned again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as rel
from ..operators.lineage import new_path
from ..sources import readers, writers
from .tables import read

MULTI = ["src0 x y", "src3 x y"]


def _results(spark, sf_dir):
    """Documents as analysis results: quotes, line breaks and separators in messages, every seventh without its last column."""
    docs = read(spark, sf_dir, "documents")
    message = F.concat(F.lit('say "a", '), F.col("lang"), F.lit("\n"), F.substring_index("text", "\n", 2))
    cells = [F.concat(F.lit("q"), F.col("source")), F.lit("d"), F.lit("error"), message, F.concat(F.lit("/repo/f"), F.col("doc_id").cast("string"), F.lit(".py"))]
    coordinates = [F.col("doc_id") % 50 + 1, F.col("doc_id") % 9 + 1, F.col("doc_id") % 50 + 2, F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") % 80 + 1)]
    path = new_path(spark, "results")
    writers.csv(docs.select(*(c.alias(n) for c, n in zip([*cells, *coordinates], readers.RESULT_COLUMNS, strict=True))), path)
    return path


def csv_results_scan(spark, sf_dir):
    whole, _ = readers.results(spark, _results(spark, sf_dir))
    return whole.select("path", "name", F.md5(F.col("message").cast("binary")).alias("message_md5"), "span.*")


def csv_results_rejects(spark, sf_dir):
    """Results without a coordinate, written to a log of rejected rows and read from it."""
    _, rejects = readers.results(spark, _results(spark, sf_dir))
    path = new_path(spark, "rejects")
    writers.rejects(rejects.select("error_type", "name", "path"), path)
    return spark.read.schema("error_type string, name string, path string").json(path)


def auxiliary_scan(spark, sf_dir):
    rows = readers.auxiliary(spark, _results(spark, sf_dir), "qsrc3")
    return rows.select("path", "start_line", "start_col", "end_line", F.coalesce("end_col", F.lit(-1)).alias("end_col"))


def generation_log_scan(spark, sf_dir):
    """Conversations as logs: the first turns are generations; blank and missing ones are empty texts."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    answer = lambda k: F.coalesce(F.get("t", F.lit(k))["text"], F.lit(""))
    path = new_path(spark, "log")
    gold = F.when(F.col("conv_id") % 3 == 0, text.NO_SPAN).otherwise(answer(0))
    writers.csv(turns.select(F.col("conv_id").alias("i"), F.lit("q").alias("query"), F.concat(F.lit("a/"), F.col("conv_id").cast("string")).alias("file_path"), F.lit("").alias("prompt"), gold.alias("ans_spans"), *(answer(k).alias(f"ans_{k}") for k in range(4))), path)
    log = readers.generations(spark, path, 4)
    signs = readers.of_sign(log, "positive").select("i", F.lit(1).alias("positive")).unionByName(readers.of_sign(log, "negative").select("i", F.lit(0).alias("positive")))
    return log.join(signs, "i").select("i", "file_path", "positive", (F.col("prompt") == "").cast("int").alias("prompt_empty"), F.size(F.filter("generations", lambda g: text.stripped(g) != "")).alias("n_written"), F.md5(F.array_join("generations", "|").cast("binary")).alias("generations_md5"))


def catalogue_scan(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    mark = lambda by: F.when(F.col("p_size") % by == 0, "1").when(F.col("p_size") % by == 1, "k").otherwise("?")
    path = new_path(spark, "catalogue")
    name = F.concat(F.lit("ql/"), F.col("p_partkey").cast("string"), F.lit(".ql"))
    writers.csv(parts.select(name.alias("Path"), F.concat(F.lit("https://github.com/"), F.col("p_brand"), F.lit("/code/tree/main/"), name).alias("Url"), F.concat(F.lit('of "'), F.col("p_type"), F.lit('", new')).alias("Description"), mark(3).alias("Hops"), mark(4).alias("Span")), path, header=True)
    return readers.catalogue(spark, path)


def query_records(spark, sf_dir):
    """Documents as queries: parts of their headers, ids, and which need one block."""
    docs = read(spark, sf_dir, "documents")
    header = F.concat(F.lit("/**\n * @name "), F.col("source"), F.lit(" x y\n * @problem.severity "), F.col("lang"), F.lit("\n */\nimport python\n"))
    queries = docs.select(F.concat(F.lit("q/"), F.col("doc_id").cast("string")).alias("path"), header.alias("content"), F.lit("single_hop").alias("hops"), F.lit("single_span").alias("span"))
    got = readers.query_records(queries, MULTI)
    return got.select("path", "name", "description", "severity", "query_id", F.col("distributable").cast("int").alias("distributable"))


def program_scan(spark, sf_dir):
    """Benchmark items as files: written one by one, listed, and read as records of a dataset."""
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("a/"), F.col("item_id").cast("string"), F.lit(".py")).alias("path"), "text")
    root, listing = new_path(spark, "files"), new_path(spark, "list")
    writers.prompt_files(items, root, "path", "text")
    # what is listed: the files that are there, and one that isn't
    written = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", "(file=.*)$", 1).alias("value"))
    written.union(spark.createDataFrame([("  ",), ("file=none/x.txt",)], "value string")).select(F.concat(F.lit(" "), F.col("value"), F.lit("\t"))).write.text(listing)
    got = readers.program_records(readers.files(spark, readers.file_list(spark, listing), root), "set", "test")
    return got.select(F.regexp_extract("dataset_path.unique_file_path", "file=([^/]*)/", 1).alias("file"), "dataset_path.split", F.col("github_path").isNull().cast("int").alias("no_repository"), "language", F.md5(F.rtrim(F.translate("content", "\x00", "")).cast("binary")).alias("content_md5"))


def recommendation_scan(spark, sf_dir):
    """Suppliers as one JSON document of recommendations."""
    rows = read(spark, sf_dir, "nation").select(F.to_json(F.map_from_arrays(F.array("n_name"), F.array(F.struct(F.concat(F.lit("see \""), F.col("n_name"), F.lit("\"")).alias("recommendation"), F.col("n_regionkey").cast("string").alias("description"))))).alias("j"))
    whole = rows.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.expr("substr(j, 2, length(j) - 2)")), ",\n"), F.lit("}")).alias("value"))
    path = new_path(spark, "json")
    whole.coalesce(1).write.text(path)
    return readers.recommendations(spark, path)


def split_round_trip(spark, sf_dir):
    """Seven files of neighbouring rows and all of them again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("example_type"))
    path = new_path(spark, "splits")
    writers.splits(docs, path, "doc_id", 7)
    return readers.splits(spark, path).groupBy("split_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def partitioned_examples_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("config"), F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"))
    path = new_path(spark, "examples")
    writers.examples(docs, path)
    return readers.examples(spark, path, "fr", "test")


def manifest_flatten(spark, sf_dir):
    """Paths of JSON manifests, one for each source."""
    one = F.to_json(F.struct(F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("filepath"), F.col("lang")))
    manifests = read(spark, sf_dir, "documents").select("source", one.alias("j")).groupBy("source").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("manifest"))
    return rel.flat_manifest(manifests, "manifest")


QUERIES = {f.__name__: f for f in (csv_results_scan, csv_results_rejects, auxiliary_scan, generation_log_scan, catalogue_scan, query_records, program_scan, recommendation_scan, split_round_trip, partitioned_examples_scan, manifest_flatten)}

HEAD = "'/**' || chr(10) || ' * @name ' || source || ' x y' || chr(10) || ' * @problem.severity ' || lang || chr(10) || ' */' || chr(10) || 'import python' || chr(10)"
TURNS = "t AS (SELECT conv_id, list(text ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id), a AS (SELECT conv_id, [coalesce(t[1], ''), coalesce(t[2], ''), coalesce(t[3], ''), coalesce(t[4], '')] AS a FROM t)"
ORACLE_SQL = {
    "csv_results_scan": """
        SELECT 'repo/f' || doc_id || '.py' AS path, 'q' || source AS name, md5('say "a", ' || lang || chr(10) || array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10))) AS message_md5,
          CAST(doc_id % 50 AS INTEGER) AS sl, CAST(doc_id % 9 AS INTEGER) AS sc, CAST(doc_id % 50 + 1 AS INTEGER) AS el, CAST(n_chars % 80 + 1 AS INTEGER) AS ec FROM documents WHERE doc_id % 7 <> 0""",
    "csv_results_rejects": "SELECT 'missing coordinate' AS error_type, 'q' || source AS name, 'repo/f' || doc_id || '.py' AS path FROM documents WHERE doc_id % 7 = 0",
    "auxiliary_scan": "SELECT 'repo/f' || doc_id || '.py' AS path, CAST(doc_id % 50 + 1 AS INTEGER) AS start_line, CAST(doc_id % 9 + 1 AS INTEGER) AS start_col, CAST(doc_id % 50 + 2 AS INTEGER) AS end_line, CAST(CASE WHEN doc_id % 7 = 0 THEN -1 ELSE n_chars % 80 + 1 END AS INTEGER) AS end_col FROM documents WHERE source = 'src3'",
    "generation_log_scan": rf"""
        WITH {TURNS} SELECT CAST(conv_id AS INTEGER) AS i, 'a/' || conv_id AS file_path, CAST(conv_id % 3 <> 0 AS INTEGER) AS positive, 1 AS prompt_empty,
          CAST(len(list_filter(a, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS INTEGER) AS n_written, md5(array_to_string(a, '|')) AS generations_md5 FROM a""",
    "catalogue_scan": """
        SELECT 'ql/' || p_partkey || '.ql' AS path, 'https://github.com/' || p_brand || '/code' AS repo, 'https://github.com/' || p_brand || '/code/tree/main/ql/' || p_partkey || '.ql' AS url,
          CASE p_size % 3 WHEN 0 THEN 'single_hop' WHEN 1 THEN 'multiple_hops' ELSE 'undefined_hop' END AS hops, CASE p_size % 4 WHEN 0 THEN 'single_span' WHEN 1 THEN 'multiple_spans' ELSE 'undefined_span' END AS span FROM part""",
    "query_records": f"SELECT 'q/' || doc_id AS path, source || ' x y' AS name, 'NA' AS description, lang AS severity, md5('q/' || doc_id || {HEAD}) AS query_id, CAST(source NOT IN ('src0', 'src3') AS INTEGER) AS distributable FROM documents",
    "program_scan": "SELECT 'a_' || item_id || '.py' AS file, 'test' AS split, 1 AS no_repository, 'python' AS language, md5(rtrim(text)) AS content_md5 FROM benchmark",
    "recommendation_scan": """SELECT n_name AS name, 'see "' || n_name || '"' AS recommendation, CAST(n_regionkey AS VARCHAR) AS description FROM nation""",
    "split_round_trip": """
        WITH r AS (SELECT doc_id, CAST(ceil(row_number() OVER (ORDER BY doc_id) * 7 / count(*) OVER ()) AS INTEGER) AS split_id FROM documents)
        SELECT split_id, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM r GROUP BY split_id""",
    "partitioned_examples_scan": "SELECT doc_id, source FROM documents WHERE lang = 'fr' AND doc_id % 10 = 0",
    "manifest_flatten": "SELECT 'f/' || doc_id AS filepath FROM documents",
}
