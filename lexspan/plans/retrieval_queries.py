"""Character n-gram retrieval: turns of a conversation are its course's units,
and every noisy sentence asks which turn it belongs to."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.operators import retrieval as R
from lexspan.plans.base import HYPS, hypotheses, query, table, tokens_sql, with_
from lexspan.session import by_id

UNITS = """units AS (SELECT printf('%08d', conv_id) AS course_id, conv_id || ':' || turn AS unit_id, turn AS unit_order, concat_ws(' ', role, text, turn) AS document FROM conversations)"""
QUERIES_SQL = "queries AS (SELECT lecture_id AS course_id, utt_id AS query_id, CASE WHEN length(hyp) % 23 = 0 THEN '  ' ELSE hyp END AS text FROM hyps WHERE cond = 'C0')"


def grams_sql(source: str, ids: str, text: str, name: str) -> str:
    return f"""{name}_w AS (SELECT {ids}, unnest(list_transform({tokens_sql(f'lower({text})')}, lambda w: ' ' || w || ' ')) AS w FROM {source}),
{name}_g AS (SELECT {ids}, w[p:p + n - 1] AS gram FROM {name}_w, unnest([3, 4, 5]) t(n), unnest(range(1, greatest(length(w) - n + 2, 1))) s(p)),
{name} AS (SELECT {ids}, gram, count(*) AS tf FROM {name}_g GROUP BY {ids}, gram)"""


WEIGHTS = UNITS + ",\n" + grams_sql("units", "course_id, unit_id", "document", "ut") + """,
n_ AS (SELECT course_id, count(*) AS n FROM units GROUP BY course_id),
df_ AS (SELECT course_id, gram, count(*) AS df FROM ut GROUP BY course_id, gram),
idf_ AS (SELECT course_id, gram, df, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM df_ JOIN n_ USING (course_id)),
w_ AS (SELECT course_id, unit_id, gram, idf, (1 + ln(tf)) * idf AS weight FROM ut JOIN idf_ USING (course_id, gram)),
norm_ AS (SELECT course_id, unit_id, sqrt(sum(weight * weight)) AS norm FROM w_ GROUP BY ALL)"""
QUERY_VEC = HYPS + ",\n" + QUERIES_SQL + ",\n" + WEIGHTS + ",\n" + grams_sql("queries", "course_id, query_id", "text", "qt") + """,
qw_ AS (SELECT course_id, query_id, gram, (1 + ln(tf)) * idf AS weight FROM qt JOIN idf_ USING (course_id, gram)),
qn_ AS (SELECT course_id, query_id, sqrt(sum(weight * weight)) AS norm FROM qw_ GROUP BY ALL)"""
SCORES = QUERY_VEC + """,
dot_ AS (SELECT course_id, query_id, unit_id, sum(q.weight * u.weight) AS dot FROM qw_ q JOIN w_ u USING (course_id, gram) GROUP BY ALL),
scores AS (SELECT course_id, query_id, unit_id, round_even(dot / (q.norm * u.norm), 9) AS score
  FROM dot_ JOIN qn_ q USING (course_id, query_id) JOIN norm_ u USING (course_id, unit_id))"""
RANKED = SCORES + """,
all_ AS (SELECT q.course_id, q.query_id, q.text, u.unit_id, u.unit_order, coalesce(s.score, 0) AS score
  FROM queries q JOIN units u USING (course_id) LEFT JOIN scores s USING (course_id, query_id, unit_id)),
rank_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_order) AS rank FROM all_),
top_ AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS got FROM rank_ WHERE rank <= 3)"""


def course_units(spark, sf):
    return table(spark, sf, "conversations").select(
        F.format_string("%08d", "conv_id").alias("course_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("unit_id"),
        F.col("turn").alias("unit_order"), R.unit_document(F.col("role"), F.col("text"), F.array(F.col("turn").cast("string"))).alias("document"))


def sentence_queries(spark, sf):
    return hypotheses(spark, sf, ("C0",)).select(
        F.col("lecture_id").alias("course_id"), F.col("utt_id").alias("query_id"), F.when(F.length("hyp") % 23 == 0, "  ").otherwise(F.col("hyp")).alias("text"))


#: Documents of a task: their distinct grams are counted in memory.
DOCUMENTS = 1_000


@query("txt8_char_grams", with_(
    grams_sql("documents", "doc_id", "text", "dg"), body="SELECT gram, sum(tf)::BIGINT AS n, count(*) AS n_docs FROM dg GROUP BY gram"))
def txt8(spark, sf):
    # texts are shuffled, not their grams: a document's grams then lie in one task, and only counts leave it
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    g = R.explode_grams(by_id(docs.select("doc_id", "text"), "doc_id", DOCUMENTS), ["doc_id"], "text")
    return g.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("tf")).groupBy("gram").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("txt11_tfidf_weights", with_(WEIGHTS, body="SELECT course_id, unit_id, gram, round_even(weight / norm, 9) AS weight FROM w_ JOIN norm_ USING (course_id, unit_id)"))
def txt11(spark, sf):
    w = R.normalized_weights(R.tfidf_weights(course_units(spark, sf)))
    return w.select("course_id", "unit_id", "gram", F.bround("weight", 9).alias("weight"))


@query("txt12_query_vectors", with_(QUERY_VEC, body="SELECT course_id, query_id, gram, round_even(weight / norm, 9) AS weight FROM qw_ JOIN qn_ USING (course_id, query_id)"))
def txt12(spark, sf):
    return R.query_vectors(sentence_queries(spark, sf), course_units(spark, sf)).withColumn("weight", F.bround("weight", 9))


@query("jn12_retrieval_scores", with_(SCORES, body="SELECT course_id, query_id, unit_id, score FROM scores"))
def jn12(spark, sf):
    return R.scores(sentence_queries(spark, sf), course_units(spark, sf))


@query("top1_units_ascending", with_(RANKED, body="SELECT course_id, query_id, unit_id, score, got - rank + 1 AS place FROM top_"))
def top1(spark, sf):
    return R.top_units(sentence_queries(spark, sf), course_units(spark, sf), 3).select("course_id", "query_id", "unit_id", "score", "place")


@query("top1_units_blank_in_order", with_(RANKED, body="SELECT course_id, query_id, unit_id, score, CASE WHEN trim(text) = '' THEN rank ELSE got - rank + 1 END AS place FROM top_"))
def top1_in_order(spark, sf):
    return R.top_units(sentence_queries(spark, sf), course_units(spark, sf), 3, blank_reversed=False).select("course_id", "query_id", "unit_id", "score", "place")


@query("top2_unit_ids_descending", with_(RANKED, body="SELECT course_id, query_id, string_agg(unit_id, '|' ORDER BY rank) AS unit_ids FROM top_ GROUP BY ALL"))
def top2(spark, sf):
    ids = R.retrieved_ids(R.top_units(sentence_queries(spark, sf), course_units(spark, sf), 3), ascending=False)
    return ids.withColumn("unit_ids", F.array_join("unit_ids", "|"))
