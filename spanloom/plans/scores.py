"""Scores: relevance, pass@k, deltas, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths, text
from ..operators import metrics
from .tables import read

#: The event types of a report.
TYPES = ("click", "error", "purchase", "signup", "view")


def _judged(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("lang", (F.col("n_chars") > 500).cast("int").alias("predicted"), F.col("quality").alias("target"))


def relevance_metrics(spark, sf_dir):
    return metrics.relevance(_judged(spark, sf_dir))


def relevance_metrics_by_query(spark, sf_dir):
    return metrics.relevance(_judged(spark, sf_dir), ["lang"])


def score_delta_by_hop(spark, sf_dir):
    """Share of long documents against share of documents with a comma early on, by source."""
    docs = read(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("n"), F.instr("text", ",").alias("c"))
    a = docs.groupBy("source").agg(F.avg((F.col("n") > 1500).cast("double")).alias("score"))
    b = docs.groupBy("source").agg(F.avg(F.col("c").between(1, 60).cast("double")).alias("score"))
    return metrics.delta_by_hop(a, b, "source", F.col("source").isin([f"src{i}" for i in range(15)])).select("hops", "n", "mean_delta", "over_10", "over_50")


def _passes(spark, sf_dir):
    """A user's events are ten generations at most; purchases are right."""
    by = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("c"), F.max(F.col("event_type") == "signup").alias("signed"))
    rows = by.select("user_id", "signed", F.lit(10).alias("n"), F.least("c", F.lit(10)).cast("int").alias("c"))
    return metrics.pass_rates(rows, (1, 2, 5, 10))


def pass_at_k(spark, sf_dir):
    return _passes(spark, sf_dir).select("user_id", "c", *(F.round(f"pass_{k}", 6).alias(f"pass_{k}") for k in (1, 2, 5, 10)))


def pass_at_k_rollup(spark, sf_dir):
    return metrics.mean_by(_passes(spark, sf_dir).withColumn("signed", F.col("signed").cast("int")), ["signed"], "pass_1", "pass_2", "pass_5", "pass_10").select("signed", F.col("all_rows").cast("int").alias("all_rows"), "n", "pass_1", "pass_2", "pass_5", "pass_10")


def multispan_bag_equality(spark, sf_dir):
    """Whether the words of a user's turn and of the next turn match as spans, and as one span."""
    turns = read(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    pairs = turns.filter("role = 'user'").join(after, ["conv_id", "turn"])
    gold = F.array_join(F.array_sort(text.words(F.col("text"))), text.SPAN_SEPARATOR)
    generation = F.array_join(F.reverse(text.words(F.col("next"))), " \n")
    return pairs.select("conv_id", "turn", metrics.matches(gold, generation).cast("int").alias("same_bag"), metrics.matches(F.col("text"), F.col("next")).cast("int").alias("same_text"))


def report_pivot(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.lit(1).alias("one"))
    got = metrics.report(rows, "user_id", "event_type", "one", TYPES)
    return got.select("user_id", *(F.coalesce(F.col(t), F.lit(0)).cast("long").alias(f"n_{t}") for t in TYPES))


def weighted_cross_entropy(spark, sf_dir):
    """Mean loss of a two-class score, class 1 counting twice."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), read(spark, sf_dir, "labels")
    z = F.col("n_chars") / 1000.0
    rows = docs.join(labels, "doc_id").select("lang", maths.cross_entropy(F.array(F.lit(0.5), z), F.col("toxic")).alias("loss"), F.when(F.col("toxic") == 1, 2.0).otherwise(1.0).alias("w"))
    return rows.groupBy("lang").agg(F.round(F.sum(F.col("w") * F.col("loss")) / F.sum("w"), 6).alias("loss"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (relevance_metrics, relevance_metrics_by_query, score_delta_by_hop, pass_at_k, pass_at_k_rollup, multispan_bag_equality, report_pivot, weighted_cross_entropy)}

J = "j AS (SELECT lang, CAST(n_chars > 500 AS INTEGER) AS p, quality AS t FROM documents JOIN labels USING (doc_id))"
M = """count(*) AS n, round(coalesce(sum(CAST(p = t AS INTEGER)) / count(*), 0), 6) AS accuracy,
       round(coalesce(count(*) FILTER (WHERE p = 1 AND t = 1) / nullif(count(*) FILTER (WHERE p = 1), 0), 0), 6) AS precision,
       round(coalesce(count(*) FILTER (WHERE p = 1 AND t = 1) / nullif(count(*) FILTER (WHERE t = 1), 0), 0), 6) AS recall FROM j"""


def _pass(k: int) -> str:
    return f"CASE WHEN 10 - c < {k} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_product(list_transform(range(10 - c + 1, 11), lambda i: 1 - {k} / CAST(i AS DOUBLE))) END"


E_ = f"e AS (SELECT user_id, CAST(least(count(*) FILTER (WHERE event_type = 'purchase'), 10) AS INTEGER) AS c, CAST(bool_or(event_type = 'signup') AS INTEGER) AS signed FROM events GROUP BY user_id), p AS (SELECT user_id, c, signed, {', '.join(f'{_pass(k)} AS pass_{k}' for k in (1, 2, 5, 10))} FROM e)"
ORACLE_SQL = {
    "relevance_metrics": f"WITH {J} SELECT {M}",
    "relevance_metrics_by_query": f"WITH {J} SELECT lang, {M} GROUP BY lang",
    "score_delta_by_hop": """
        WITH s AS (SELECT source, round(avg(CAST(instr(text, ',') BETWEEN 1 AND 60 AS DOUBLE)) - avg(CAST(n_chars > 1500 AS DOUBLE)), 9) AS d FROM documents GROUP BY source)
        SELECT CASE WHEN CAST(substr(source, 4) AS INTEGER) < 15 THEN 'multi' ELSE 'single' END AS hops, count(*) AS n, round(avg(d), 6) AS mean_delta, count(*) FILTER (WHERE d > 0.1) AS over_10, count(*) FILTER (WHERE d > 0.5) AS over_50 FROM s GROUP BY hops""",
    "pass_at_k": f"WITH {E_} SELECT user_id, c, {', '.join(f'round(pass_{k}, 6) AS pass_{k}' for k in (1, 2, 5, 10))} FROM p",
    "pass_at_k_rollup": f"WITH {E_} SELECT signed, CAST(GROUPING(signed) AS INTEGER) AS all_rows, count(*) AS n, {', '.join(f'round(avg(pass_{k}), 6) AS pass_{k}' for k in (1, 2, 5, 10))} FROM p GROUP BY ROLLUP (signed)",
    "multispan_bag_equality": r"""
        WITH w AS (SELECT u.conv_id, u.turn, list_sort(list_filter(regexp_split_to_array(u.text, '\s+'), lambda x: x <> '')) AS a, list_filter(regexp_split_to_array(a.text, '\s+'), lambda x: x <> '') AS b, u.text AS ut, a.text AS nt
                   FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user')
        SELECT conv_id, turn, CAST(CASE WHEN len(a) > 1 THEN a = list_sort(b) ELSE array_to_string(a, '') = array_to_string(list_reverse(b), chr(32) || chr(10)) END AS INTEGER) AS same_bag,
               CAST(regexp_replace(ut, '^\s+|\s+$', '', 'g') = regexp_replace(nt, '^\s+|\s+$', '', 'g') AS INTEGER) AS same_text FROM w""",
    "report_pivot": f"SELECT user_id, {', '.join(f'''count(*) FILTER (WHERE event_type = '{t}') AS n_{t}''' for t in TYPES)} FROM events GROUP BY user_id",
    "weighted_cross_entropy": """
        WITH r AS (SELECT lang, toxic, n_chars / 1000.0 AS z FROM documents JOIN labels USING (doc_id)),
        l AS (SELECT lang, CASE WHEN toxic = 1 THEN 2.0 ELSE 1.0 END AS w, ln(exp(0.5 - greatest(0.5, z)) + exp(z - greatest(0.5, z))) + greatest(0.5, z) - CASE WHEN toxic = 1 THEN z ELSE 0.5 END AS loss FROM r)
        SELECT lang, round(sum(CAST(w AS DOUBLE) * loss) / sum(CAST(w AS DOUBLE)), 6) AS loss, count(*) AS n FROM l GROUP BY lang""",
}
