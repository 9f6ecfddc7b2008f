"""BM25, prompts and BLEU of what is retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.maths import expected_best
from ..operators import metrics
from ..operators import retrieval as R
from ..operators.lineage import materialize
from .tables import read


def _ranked(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    queries = read(spark, sf_dir, "benchmark").select("item_id", text.pieces(F.col("text")).alias("tokens"))
    corpus = read(spark, sf_dir, "documents").select("doc_id", text.pieces(text.sanitized(F.col("text"))).alias("tokens"))
    return R.bm25(queries, corpus, top)


def bm25_top1(spark, sf_dir):
    return _ranked(spark, sf_dir, 1)


def bm25_top2(spark, sf_dir):
    return _ranked(spark, sf_dir, 2)


def prompt_render(spark, sf_dir):
    """A few-shot prompt for each benchmark item from its best document."""
    best = _ranked(spark, sf_dir, 1)
    items, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    # the few best go to the documents, which aren't shuffled
    joined = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(best.join(items.withColumnRenamed("text", "query"), "item_id")), "doc_id")
    shot = R.shot(text.sanitized(F.col("text")), text.joined_spans(F.filter(F.array("lang", "source"), lambda x: x != "en")))
    made = joined.select("item_id", "doc_id", R.few_shot(F.concat(F.lit("q"), F.col("item_id").cast("string")), F.lit("find it"), F.array(shot), text.sanitized(F.col("query"))).alias("prompt"))
    kept, long = R.within_limit(materialize(made, "prompts"), F.size(text.words(F.col("prompt"))))
    out = kept.withColumn("status", F.lit("ok")).unionByName(long.withColumnRenamed("error_type", "status"))
    return out.select("item_id", "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "status", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def _pairs(spark, sf_dir):
    best = _ranked(spark, sf_dir, 10)
    items, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    joined = docs.select("doc_id", "text").join(F.broadcast(best.join(items.withColumnRenamed("text", "query"), "item_id")), "doc_id")
    return metrics.bleu(joined, ["item_id", "doc_id", "rank"], text.words(F.col("query")), text.words(F.col("text")))


def bleu_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("bleu", F.round("bleu", 6))


def score_at_k(spark, sf_dir):
    by = _pairs(spark, sf_dir).groupBy("item_id").agg(F.collect_list("bleu").alias("x"))
    return by.select("item_id", *(F.round(expected_best(F.col("x"), 10, k), 6).alias(f"score_{k}") for k in (1, 2, 5, 10)))


BM25 = """
d AS (SELECT doc_id, string_split(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) || chr(10), ' ') AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS dl FROM d),
c AS (SELECT doc_id, unnest(t) AS token FROM d),
tf AS (SELECT doc_id, token, count(*) AS tf FROM c GROUP BY ALL),
w AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idf AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, w GROUP BY token, n),
fl AS (SELECT 0.25 * avg(raw) AS f FROM idf),
q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(string_split(text, ' ')) AS token FROM benchmark) GROUP BY ALL),
m AS (SELECT q.item_id, tf.doc_id, round(sum(qtf * (CASE WHEN raw < 0 THEN f ELSE raw END) * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * dl.dl / avgdl))), 6) AS score
      FROM q JOIN idf USING (token) JOIN tf USING (token) JOIN dl USING (doc_id), w, fl GROUP BY ALL),
s AS (SELECT b.item_id, d.doc_id, coalesce(m.score, 0) AS score FROM benchmark b CROSS JOIN d LEFT JOIN m ON m.item_id = b.item_id AND m.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
"""

WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"


def _pair_sql() -> str:
    grams = lambda side: " UNION ALL ".join(f"SELECT item_id, doc_id, {n} AS n, unnest(list_transform(range(1, len({side}) - {n - 2}), lambda i: array_to_string(list_slice({side}, i, i + {n - 1}), chr(1)))) AS g FROM p WHERE len({side}) >= {n}" for n in (1, 2, 3, 4))
    return (
        f"WITH {BM25}, p AS (SELECT item_id, doc_id, rank, {WORDS.format('b.text')} AS r, {WORDS.format('d2.text')} AS c FROM r JOIN benchmark b USING (item_id) JOIN documents d2 USING (doc_id) WHERE rank <= 10), "
        f"gr AS (SELECT item_id, doc_id, n, g, count(*) AS k FROM ({grams('r')}) GROUP BY ALL), gc AS (SELECT item_id, doc_id, n, g, count(*) AS k FROM ({grams('c')}) GROUP BY ALL), "
        "u AS (SELECT item_id, doc_id, n, sum(least(gr.k, gc.k)) AS h FROM gr JOIN gc USING (item_id, doc_id, n, g) GROUP BY ALL), "
        f"h AS (SELECT p.item_id, p.doc_id, p.rank, len(r) AS lr, len(c) AS lc, {', '.join(f'coalesce((SELECT h FROM u WHERE u.item_id = p.item_id AND u.doc_id = p.doc_id AND n = {n}), 0) AS h{n}, greatest(len(c) - {n - 1}, 1) AS t{n}' for n in (1, 2, 3, 4))} FROM p), "
        "x AS (SELECT item_id, doc_id, rank, CASE WHEN lc = 0 OR h1 = 0 THEN 0.0 ELSE exp((CASE WHEN lc >= lr THEN 0.0 ELSE 1 - lr / lc END) + (ln(h1 / t1) + ln((h2 + 1) / (t2 + 1)) + ln((h3 + 1) / (t3 + 1)) + ln((h4 + 1) / (t4 + 1))) / 4) END AS bleu FROM h)"
    )


def _score_sql() -> str:
    from math import comb

    cols = ", ".join(f"round(sum(bleu * (CASE k {' '.join(f'WHEN {i + 1} THEN {comb(i, k - 1) / comb(10, k)!r}' for i in range(10))} END)), 6) AS score_{k}" for k in (1, 2, 5, 10))
    return _pair_sql() + f", o AS (SELECT item_id, bleu, 10 - count(*) OVER (PARTITION BY item_id) + row_number() OVER (PARTITION BY item_id ORDER BY bleu) AS k FROM x) SELECT item_id, {cols} FROM o GROUP BY item_id"


QUERIES = {f.__name__: f for f in (bm25_top1, bm25_top2, prompt_render, bleu_pairs, score_at_k)}
ORACLE_SQL = {
    **{f"bm25_top{k}": f"WITH {BM25} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= {k}" for k in (1, 2)},
    "prompt_render": rf"""
        WITH {BM25},
        p AS (SELECT item_id, doc_id,
          'Example code:' || chr(10) || '```python' || chr(10) || array_to_string(list_filter(string_split(d2.text, chr(10)), lambda x: x <> ''), chr(10)) || chr(10) || '```' || chr(10) || 'Answer span(s)' || chr(10) || '```python' || chr(10)
          || CASE WHEN lang = 'en' THEN source ELSE lang || ':::-:::' || source END || chr(10) || '```' || chr(10) || chr(10)
          || 'Query: q' || item_id || chr(10) || 'What it reports: find it' || chr(10) || chr(10) || 'Code:' || chr(10) || '```python' || chr(10)
          || array_to_string(list_filter(string_split(b.text, chr(10)), lambda x: x <> ''), chr(10)) || chr(10) || '```' || chr(10) || chr(10) || 'List the spans that answer the query, or N/A.' || chr(10) AS prompt
          FROM r JOIN benchmark b USING (item_id) JOIN documents d2 USING (doc_id) WHERE rank = 1)
        SELECT item_id, doc_id, CAST(len({WORDS.format('prompt')}) AS BIGINT) AS n_tokens, CASE WHEN len({WORDS.format('prompt')}) <= 4000 THEN 'ok' ELSE 'prompt too long' END AS status, md5(prompt) AS prompt_md5 FROM p
    """,
    "bleu_pairs": _pair_sql() + " SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, round(bleu, 6) AS bleu FROM x",
    "score_at_k": _score_sql(),
}
