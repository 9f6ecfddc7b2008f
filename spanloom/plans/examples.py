"""Examples from conversations: a conversation is a file, its turns are blocks, the assistant's are relevant."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import examples as X
from ..operators import metrics
from .labels import label
from .tables import read


def _blocks(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("w", text.words(F.col("text")))
    return turns.select("conv_id", F.col("turn").alias("block_pos"), F.col("role"), F.md5(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary")).alias("block_id"), F.col("w").alias("tokens"), F.transform("w", label).alias("labels"), (F.col("role") == "assistant").alias("relevant"), (F.size("w") > 12).alias("predicted"), F.array(F.lit("who"), F.lit("said"), F.lit("it")).alias("query"), (F.col("role") == "system").alias("distributable"))


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def span_examples(spark, sf_dir):
    """Examples of relevant turns, fitted to 128 places."""
    made = X.span_examples(_blocks(spark, sf_dir), ["conv_id"], "query").withColumn("e", X.fitted(F.col("example"), 128))
    return made.select("conv_id", F.size("example.tokens").cast("long").alias("n_tokens"), F.md5(F.concat_ws(";", _text(F.col("e.tokens")), _text(F.col("e.labels")), _text(F.col("e.segments")), _text(F.col("e.mask"))).cast("binary")).alias("example_md5"))


def relevance_examples(spark, sf_dir):
    made = X.relevance_examples(_blocks(spark, sf_dir), ["conv_id"], "query", with_single_hop=False)
    return made.select("conv_id", F.col("block_pos").alias("turn"), F.size("example.tokens").cast("long").alias("n_tokens"), "relevance_label", F.md5(_text(F.col("example.tokens")).cast("binary")).alias("tokens_md5"))


def groupwise_examples(spark, sf_dir):
    made = X.groupwise_examples(_blocks(spark, sf_dir), ["conv_id"], "query")
    return made.select("conv_id", F.size("items").cast("long").alias("n_blocks"), F.array_join(F.transform("items", lambda x: x["relevance_label"].cast("string")), "").alias("relevance"), F.aggregate("items", F.lit(0), lambda a, x: a + F.size(x["example"]["tokens"])).cast("long").alias("n_tokens"))


def twostep_concat_match(spark, sf_dir):
    """Turns of more than twelve words are predicted relevant; whether their spans are those of the relevant ones."""
    both = X.two_step(_blocks(spark, sf_dir), ["conv_id"])
    joined = arrays.joined(F.transform("predicted_blocks", lambda b: b["tokens"]), F.lit("[SEP]_"))
    same = arrays.same_set(X.block_spans(F.col("predicted_blocks")), X.block_spans(F.col("target_blocks")))
    return both.select("conv_id", F.size("predicted_blocks").cast("long").alias("n_predicted"), F.size("target_blocks").cast("long").alias("n_relevant"), F.md5(F.array_join(joined, " ").cast("binary")).alias("input_md5"), same.cast("int").alias("em"))


def span_words_bleu(spark, sf_dir):
    """Words of predicted against relevant spans of a conversation, and their BLEU."""
    both = X.two_step(_blocks(spark, sf_dir), ["conv_id"])
    words = both.select("conv_id", *(metrics.block_span_words(F.col(f"{k}_blocks")).alias(k) for k in ("predicted", "target")))
    scored = metrics.bleu(words, ["conv_id", "predicted", "target"], F.col("target"), F.col("predicted"))
    return scored.select("conv_id", F.size("predicted").cast("long").alias("n_predicted"), F.size("target").cast("long").alias("n_target"), F.md5(F.array_join("predicted", " ").cast("binary")).alias("predicted_md5"), (F.col("bleu") > 0).cast("int").alias("any_match"))


QUERIES = {f.__name__: f for f in (span_words_bleu, span_examples, relevance_examples, groupwise_examples, twostep_concat_match)}

W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
LABEL = "CASE WHEN regexp_matches(x, '[0-9]') THEN 3 WHEN regexp_matches(x, '^[A-Z]') THEN 0 WHEN length(x) <= 3 THEN 1 ELSE 2 END"
B = f"b AS (SELECT conv_id, turn, role, {W} AS w, role = 'assistant' AS relevant, len({W}) > 12 AS predicted, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations)"
SPANS = """{0} AS (SELECT conv_id, arg_min(label, pos) AS tag, turn, min(pos) AS first, max(pos) AS last FROM (SELECT *, sum(CAST(label <> 1 AS INTEGER)) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM t WHERE {1} OR k = 1) GROUP BY conv_id, turn, run HAVING arg_min(label, pos) IN (0, 3))"""
ORACLE_SQL = {
    "span_examples": f"""
        WITH {B}, g AS (SELECT conv_id, string_agg(array_to_string(w, ' '), ' [SEP]_ ' ORDER BY turn) AS t, string_agg(array_to_string(list_transform(w, lambda x: {LABEL}), ' '), ' 4 ' ORDER BY turn) AS l FROM b WHERE relevant GROUP BY conv_id),
        a AS (SELECT conv_id, list_concat(['[CLS]_', 'who', 'said', 'it', '[SEP]_'], list_filter(string_split(t, ' '), lambda x: x <> '')) AS t, list_concat(['4', '4', '4', '4', '4'], list_filter(string_split(l, ' '), lambda x: x <> '')) AS l FROM g)
        SELECT conv_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(list_resize(t, 128, '[PAD]_'), ' ') || ';' || array_to_string(list_resize(l, 128, '4'), ' ') || ';'
          || array_to_string(list_transform(range(128), lambda i: CASE WHEN i >= 5 AND i < len(t) THEN 1 ELSE 0 END), ' ') || ';' || array_to_string(list_transform(range(128), lambda i: CASE WHEN i < len(t) THEN 1 ELSE 0 END), ' ')) AS example_md5 FROM a""",
    "relevance_examples": f"WITH {B} SELECT conv_id, turn, CAST(len(w) + 5 AS BIGINT) AS n_tokens, CAST(relevant AS INTEGER) AS relevance_label, md5(array_to_string(list_concat(['[CLS]_', 'who', 'said', 'it', '[SEP]_'], w), ' ')) AS tokens_md5 FROM b WHERE role <> 'system'",
    "groupwise_examples": f"WITH {B} SELECT conv_id, count(*) AS n_blocks, string_agg(CASE WHEN relevant THEN '1' ELSE '0' END, '' ORDER BY turn) AS relevance, CAST(sum(len(w) + 5) AS BIGINT) AS n_tokens FROM b GROUP BY conv_id",
    "twostep_concat_match": f"""
        WITH {B}, t AS (SELECT conv_id, turn, k, relevant, predicted, {LABEL.replace('x', 'y')} AS label, pos FROM (SELECT conv_id, turn, k, relevant, predicted, unnest(w) AS y, generate_subscripts(w, 1) AS pos FROM b)),
        {SPANS.format('p', 'predicted')}, {SPANS.format('q', 'relevant')},
        x AS (SELECT DISTINCT conv_id FROM ((SELECT * FROM p EXCEPT SELECT * FROM q) UNION ALL (SELECT * FROM q EXCEPT SELECT * FROM p)))
        SELECT conv_id, count(*) FILTER (WHERE predicted OR k = 1) AS n_predicted, count(*) FILTER (WHERE relevant OR k = 1) AS n_relevant,
          md5(coalesce(string_agg(array_to_string(w, ' '), ' [SEP]_ ' ORDER BY turn) FILTER (WHERE predicted OR k = 1), '')) AS input_md5, CAST(conv_id NOT IN (SELECT conv_id FROM x) AS INTEGER) AS em FROM b GROUP BY conv_id""",
}
ORACLE_SQL["twostep_concat_match"] = ORACLE_SQL["twostep_concat_match"].replace(LABEL.replace("x", "y"), LABEL.replace("(x,", "(y,").replace("length(x)", "length(y)"))
ORACLE_SQL["span_words_bleu"] = ORACLE_SQL["twostep_concat_match"].split("x AS (SELECT DISTINCT")[0] + """
        wd AS (SELECT conv_id, turn, unnest(w) AS y, generate_subscripts(w, 1) AS pos FROM b),
        np AS (SELECT *, CASE WHEN tag = 0 THEN 'ans' ELSE 'sf' END || (row_number() OVER (PARTITION BY conv_id, tag ORDER BY turn, first) - 1) AS mark FROM p),
        nq AS (SELECT *, CASE WHEN tag = 0 THEN 'ans' ELSE 'sf' END || (row_number() OVER (PARTITION BY conv_id, tag ORDER BY turn, first) - 1) AS mark FROM q),
        lp AS (SELECT conv_id, turn, first, 0 AS pos, mark AS y FROM np UNION ALL SELECT np.conv_id, np.turn, np.first, wd.pos, wd.y FROM np JOIN wd ON wd.conv_id = np.conv_id AND wd.turn = np.turn AND wd.pos BETWEEN np.first AND np.last),
        lq AS (SELECT conv_id, turn, first, 0 AS pos, mark AS y FROM nq UNION ALL SELECT nq.conv_id, nq.turn, nq.first, wd.pos, wd.y FROM nq JOIN wd ON wd.conv_id = nq.conv_id AND wd.turn = nq.turn AND wd.pos BETWEEN nq.first AND nq.last),
        gp AS (SELECT conv_id, count(*) AS n, string_agg(y, ' ' ORDER BY turn, first, pos) AS s FROM lp GROUP BY conv_id), gq AS (SELECT conv_id, count(*) AS n FROM lq GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gp.n, 0) AS n_predicted, coalesce(gq.n, 0) AS n_target, md5(coalesce(gp.s, '')) AS predicted_md5, CAST(EXISTS (SELECT 1 FROM lp JOIN lq USING (conv_id, y) WHERE lp.conv_id = c.conv_id) AS INTEGER) AS any_match
        FROM (SELECT DISTINCT conv_id FROM b) c LEFT JOIN gp USING (conv_id) LEFT JOIN gq USING (conv_id)"""
