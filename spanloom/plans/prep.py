"""Joins, groupings, sampling and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import relational as rel
from ..operators import sampling as S
from .tables import read


def sanitize_content(spark, sf_dir):
    clean = text.sanitized(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(clean.cast("binary")).alias("content_md5"), F.length(clean).cast("long").alias("n_chars"))


def block_content_concat(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", text.sanitized(F.col("text")).alias("c")).alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["c"]), "")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_blocks"), joined.alias("content")).select("conv_id", "n_blocks", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def content_md5_id(spark, sf_dir):
    lines = F.size(F.split("text", "\n"))
    return read(spark, sf_dir, "documents").select("doc_id", ids.block_id(F.col("source"), F.col("text"), F.lit(0), lines - 1, F.lit(2)).alias("block_id"), ids.query_id(F.col("source"), F.col("text")).alias("query_id"))


def group_identity_dedup(spark, sf_dir):
    """Orders whose lines have the same flags and numbers are one group."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", ids.md5_of(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")).alias("block_id"))
    groups = lines.groupBy("l_orderkey").agg(ids.group_id(F.lit("q"), F.lit("p"), F.collect_list("block_id")).alias("group_id"))
    return groups.groupBy("group_id").agg(F.count("*").alias("n_orders"), F.min("l_orderkey").alias("first_order"))


def ambiguity_label_merge(spark, sf_dir):
    """Lines of an order as labels; groups of the same length merge."""
    labels = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: F.when(x["l_returnflag"] == "R", 0).when(x["l_returnflag"] == "A", 1).otherwise(2)).alias("labels"))
    groups = labels.select(F.concat(F.lit("g"), F.size("labels").cast("string")).alias("group_id"), F.col("l_orderkey").alias("order"), "labels")
    merged = rel.merged_groups(groups)
    return merged.select("group_id", F.col("order").alias("first_order"), F.array_join("labels", ",").alias("labels"))


def results_merge(spark, sf_dir):
    results = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("query"), "l_linenumber", "l_suppkey")
    programs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), "o_orderpriority")
    queries = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), "p_brand")
    joined, _ = rel.resolved(results, programs, queries, "path", "query")
    out = rel.merged(joined, ["path", "p_brand", "o_orderpriority"], F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")), F.struct("l_linenumber", "l_suppkey"))
    return out.select("path", "p_brand", "o_orderpriority", F.size("locations").cast("long").alias("n_locations"), F.array_join("locations", ",").alias("locations"))


def left_anti_rejects(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return S.lacking(docs, labels, ["doc_id"]).select("doc_id", "source", F.lit("no label").alias("error_type"))


def semi_join_sample(spark, sf_dir):
    """Documents of a sample of ten positive and ten negative labelled ones of each language."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), read(spark, sf_dir, "labels")
    sample = S.stratified(docs.join(labels, "doc_id").select("doc_id", "lang", "quality"), ["lang", "quality"], ["doc_id"], 10)
    return S.selected(docs, sample, ["doc_id"])


def neg_downsample_3to1(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return S.negatives(labels, F.col("toxic") == 1, ["doc_id"])


def adaptive_negatives(spark, sf_dir):
    """Negatives of three epochs: half of them, then twice refreshed from the others."""
    neg = read(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id")
    first = neg.filter(S.rank_key(1, "doc_id") < "8")
    rest = S.lacking(neg, first, ["doc_id"])
    second = S.refreshed(first, rest, ["doc_id"])
    third = S.refreshed(second, rest, ["doc_id"])
    tag = lambda df, e: df.select(F.lit(e).alias("epoch"), "doc_id")
    return tag(first, 1).unionByName(tag(second, 2)).unionByName(tag(third, 3)).groupBy("epoch", "doc_id").agg(F.count("*").alias("times"))


def contiguous_splits(spark, sf_dir):
    return rel.contiguous_splits(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 20).select("doc_id", F.col("idx").cast("long").alias("idx"), "split_id")


def file_level_groups(spark, sf_dir):
    """Examples of each (query, file), and whether they are of one type."""
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n_examples"), (F.count_distinct("l_linestatus") == 1).cast("int").alias("one_type"))


def block_relevance_merge(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    blocks = lines.select("l_partkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", "STUB").otherwise("MODULE_FUNCTION").alias("block_type"), (F.col("l_returnflag") == "R").alias("relevant"))
    return rel.merged_relevance(blocks, ["l_partkey", "l_linenumber"]).withColumn("relevant", F.col("relevant").cast("int"))


def example_union(spark, sf_dir):
    """Positive and negative examples together, and how many of either there are by language."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select("doc_id", "lang", F.col("quality").cast("int").alias("example_type"))
    whole = rel.both_kinds(S.of_kind(rows, "positive"), S.of_kind(rows, "negative"))
    return whole.groupBy("lang", "example_type").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def querywise_stat(spark, sf_dir):
    """Rows of each source in all, with and without label; the two add up."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    marked = docs.select("doc_id", "source").join(labels.select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return marked.groupBy("source").agg(F.count("*").alias("n"), F.count("has").alias("n_labelled"), F.count_if(F.col("has").isNull()).alias("n_unlabelled"))


def span_collection(spark, sf_dir):
    """Words of positive turns, flattened by conversation in order of turn."""
    turns = read(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", F.struct("turn", text.words(F.col("text")).alias("w")).alias("x"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]))
    return turns.groupBy("conv_id").agg(flat.alias("w")).select("conv_id", F.size("w").cast("long").alias("n_spans"), F.md5(text.joined_spans(F.col("w")).cast("binary")).alias("spans_md5"))


def size_filter(spark, sf_dir):
    """Documents of English under 700 words: the pool of examples."""
    docs = read(spark, sf_dir, "documents").filter("lang = 'en'")
    return docs.select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("file_tokens")).filter("file_tokens < 700")


def query_size_filter(spark, sf_dir):
    """Documents of a language within the size of its split: 3000 words in tests (ids divisible by ten), 1000 in training."""
    docs = read(spark, sf_dir, "documents").filter("lang = 'fr'")
    sized = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"), F.size(text.words(F.col("text"))).cast("long").alias("file_tokens"))
    return sized.filter(F.col("file_tokens") < F.when(F.col("split") == "test", 3000).otherwise(1000))


QUERIES = {f.__name__: f for f in (query_size_filter, sanitize_content, block_content_concat, content_md5_id, group_identity_dedup, ambiguity_label_merge, results_merge, left_anti_rejects, semi_join_sample, neg_downsample_3to1, adaptive_negatives, contiguous_splits, file_level_groups, block_relevance_merge, example_union, querywise_stat, span_collection, size_filter)}

CLEAN = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) || chr(10)"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
ORACLE_SQL = {
    "sanitize_content": f"SELECT doc_id, md5({CLEAN}) AS content_md5, CAST(length({CLEAN}) AS BIGINT) AS n_chars FROM documents",
    "block_content_concat": f"SELECT conv_id, count(*) AS n_blocks, md5(string_agg({CLEAN}, '' ORDER BY turn)) AS content_md5 FROM conversations GROUP BY conv_id",
    "content_md5_id": "SELECT doc_id, md5(source || text || '0' || (len(string_split(text, chr(10))) - 1) || '2') AS block_id, md5(source || text) AS query_id FROM documents",
    "group_identity_dedup": """
        WITH g AS (SELECT l_orderkey, md5('q' || 'p' || string_agg(b, '' ORDER BY b)) AS group_id
                   FROM (SELECT l_orderkey, md5(l_returnflag || l_linestatus || l_linenumber) AS b FROM lineitem) GROUP BY l_orderkey)
        SELECT group_id, count(*) AS n_orders, min(l_orderkey) AS first_order FROM g GROUP BY group_id""",
    "ambiguity_label_merge": """
        WITH l AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS label,
                          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
        b AS (SELECT 'g' || n AS group_id, pos, coalesce(arg_min(label, l_orderkey) FILTER (WHERE label <> 2), 2) AS label FROM l GROUP BY n, pos),
        f AS (SELECT 'g' || n AS group_id, min(l_orderkey) AS first_order FROM l GROUP BY n)
        SELECT group_id, first_order, string_agg(CAST(label AS VARCHAR), ',' ORDER BY pos) AS labels FROM b JOIN f USING (group_id) GROUP BY ALL""",
    "results_merge": """
        SELECT l_orderkey AS path, p_brand, o_orderpriority, count(*) AS n_locations, string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) AS locations
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
    "left_anti_rejects": "SELECT doc_id, source, 'no label' AS error_type FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "semi_join_sample": """
        WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, quality ORDER BY md5('42|' || doc_id), doc_id) AS n FROM documents JOIN labels USING (doc_id))
        SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM r WHERE n <= 10)""",
    "neg_downsample_3to1": """
        WITH p AS (SELECT count(*) AS n FROM labels WHERE toxic = 1),
        r AS (SELECT doc_id, toxic, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS k FROM labels WHERE toxic = 0)
        SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, toxic FROM r, p WHERE k <= 3 * n""",
    "adaptive_negatives": """
        WITH neg AS (SELECT doc_id FROM labels WHERE toxic = 0),
        e1 AS (SELECT doc_id FROM neg WHERE md5('1|' || doc_id) < '8'),
        buf AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS k FROM neg WHERE doc_id NOT IN (SELECT doc_id FROM e1)),
        s AS (SELECT count(*) AS n, CAST(floor(0.6 * count(*)) AS BIGINT) AS keep FROM e1),
        r1 AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS k FROM e1),
        e2 AS (SELECT doc_id FROM r1, s WHERE k <= keep UNION ALL SELECT doc_id FROM buf, s WHERE k <= n - keep),
        s2 AS (SELECT count(*) AS n, CAST(floor(0.6 * count(*)) AS BIGINT) AS keep FROM e2),
        r2 AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS k FROM e2),
        e3 AS (SELECT doc_id FROM r2, s2 WHERE k <= keep UNION ALL SELECT doc_id FROM buf, s2 WHERE k <= n - keep),
        a AS (SELECT 1 AS epoch, doc_id FROM e1 UNION ALL SELECT 2, doc_id FROM e2 UNION ALL SELECT 3, doc_id FROM e3)
        SELECT epoch, doc_id, count(*) AS times FROM a GROUP BY ALL""",
    "contiguous_splits": """
        WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
        SELECT doc_id, idx, CAST(ceil((idx + 1) * 20 / n) AS INTEGER) AS split_id FROM r""",
    "file_level_groups": "SELECT l_suppkey, l_partkey, count(*) AS n_examples, CAST(count(DISTINCT l_linestatus) = 1 AS INTEGER) AS one_type FROM lineitem GROUP BY ALL",
    "block_relevance_merge": "SELECT l_partkey, l_linenumber, CAST(bool_or(l_returnflag = 'R') AS INTEGER) AS relevant FROM lineitem WHERE l_linestatus <> 'F' GROUP BY ALL",
    "example_union": "SELECT lang, CAST(quality AS INTEGER) AS example_type, count(*) AS n, min(doc_id) AS first_doc FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY ALL",
    "querywise_stat": "SELECT source, count(*) AS n, count(l.doc_id) AS n_labelled, count(*) - count(l.doc_id) AS n_unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source",
    "span_collection": f"""
        WITH t AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations WHERE role = 'assistant'),
        a AS (SELECT conv_id, flatten(list(w ORDER BY turn)) AS w FROM t GROUP BY conv_id)
        SELECT conv_id, CAST(len(w) AS BIGINT) AS n_spans, md5(CASE WHEN len(w) > 0 THEN array_to_string(w, ':::-:::') ELSE 'N/A' END) AS spans_md5 FROM a""",
    "query_size_filter": f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, CAST(len({WORDS}) AS BIGINT) AS file_tokens FROM documents WHERE lang = 'fr' AND len({WORDS}) < CASE WHEN doc_id % 10 = 0 THEN 3000 ELSE 1000 END",
    "size_filter": f"SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS file_tokens FROM documents WHERE lang = 'en' AND len({WORDS}) < 700",
}
