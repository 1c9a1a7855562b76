"""Span, note, coverage, citation, catalog and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.functions.seeded import seeded_hash
from lexspan.operators import catalog as C
from lexspan.operators import citations as R
from lexspan.operators import coverage as V
from lexspan.operators import quality as Q
from lexspan.operators import spans as P
from lexspan.plans.base import (
    SPANS, VECTORS, hash_sql, items, lectures, mixed_script, mixed_script_sql, norm_sql, notes, query, questions, ranged_notes, spans,
    subjects, table, tokens_sql, units, with_, words_sql,
)
from lexspan.plans.manifests import SYLLABI, syllabi
from lexspan.sources import tables as T

# --- chunks, checks, frames ----------------------------------------------------------
# every fifth turn is silent, so some windows are blank
SILENT = "sp_ AS (SELECT lecture_id, index, start_s, end_s, CASE WHEN length(text) % 5 = 0 THEN ' ' ELSE text END AS text FROM spans)"


def silent_spans(spark, sf):
    return spans(spark, sf).withColumn("text", F.when(F.length("text") % 5 == 0, " ").otherwise(F.col("text")))


@query("win3_overlapping_chunks", with_(SPANS, SILENT, """pos_ AS (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY index) - 1 AS p, count(*) OVER (PARTITION BY lecture_id) AS n FROM sp_),
st_ AS (SELECT DISTINCT lecture_id, n, s FROM pos_, unnest(range(0, n, 2)) t(s) WHERE s = 0 OR s + 1 < n),
ch_ AS (SELECT st_.lecture_id, s, string_agg(text, ' ' ORDER BY p) AS t, min_by(start_s, p) AS start_s, max_by(end_s, p) AS end_s, string_agg(index::VARCHAR, ',' ORDER BY p) AS span_indices
  FROM st_ JOIN pos_ ON pos_.lecture_id = st_.lecture_id AND p BETWEEN s AND s + 2 GROUP BY ALL)""",
    body="""SELECT lecture_id || ':w' || s AS id, lecture_id, trim(t) AS document, start_s, end_s, span_indices, subject_id, lecture_title, 'span' AS kind
      FROM ch_ LEFT JOIN lectures USING (lecture_id) WHERE trim(t) <> ''"""))
def win3(spark, sf):
    return P.overlapping_chunks(silent_spans(spark, sf), lectures(spark, sf))


@query("win9_span_checks", with_(SPANS, """x_ AS (SELECT lecture_id, index, start_s + CASE WHEN length(text) % 50 = 0 THEN 1 ELSE 0 END AS start_s, end_s FROM spans),
y_ AS (SELECT x_.*, duration_s, lag(end_s) OVER w AS pe, lead(end_s) OVER w IS NULL AS last FROM x_ JOIN lectures USING (lecture_id) WINDOW w AS (PARTITION BY lecture_id ORDER BY index))""",
    body="""SELECT lecture_id, count(*) AS n_spans, bool_and(pe IS NULL OR abs(start_s - pe) <= 1e-6) AS contiguous, bool_and(NOT last OR abs(end_s - duration_s) <= 1e-6) AS ends_at_duration,
      bool_and(end_s - start_s <= 28 + 1e-6) AS all_within_max, bool_and(last OR end_s - start_s >= 8) AS all_but_last_reach_min FROM y_ GROUP BY lecture_id"""))
def win9(spark, sf):
    s = spans(spark, sf).withColumn("start_s", F.col("start_s") + F.when(F.length("text") % 50 == 0, 1).otherwise(0))
    return P.span_checks(s, lectures(spark, sf))


# an embedding is a short recording, its components the samples
@query("agg18_frame_energy", """WITH x AS (SELECT vec_id AS rec, d - 1 AS pos, embedding[d]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) t(d)),
f AS (SELECT rec, pos // 5 AS frame, count(*) AS k, avg(x * x) AS ms FROM x GROUP BY ALL)
SELECT rec, frame, round_even(sqrt(ms + 1e-12), 9) AS rms FROM f WHERE k = 5""")
def agg18(spark, sf):
    x = table(spark, sf, "embeddings").select(F.col("vec_id").alias("rec"), F.posexplode("embedding").alias("pos", "x"))
    return P.frame_energy(x, 5).withColumn("rms", F.bround("rms", 9))


# a customer's orders by time are the frames of a recording: half a second each
FRAMES = """fr_ AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS rms FROM events),
ln_ AS (SELECT rec, count(*) / 1.0::DOUBLE AS total_s, count(*) AS n FROM fr_ GROUP BY rec)"""
WALK = FRAMES + """,
wk(rec, index, start_s, end_s, total_s, n) AS (
  SELECT rec, -1, 0.0::DOUBLE, 0.0::DOUBLE, total_s, n FROM ln_
  UNION ALL
  SELECT rec, index + 1, end_s, CASE WHEN total_s - end_s <= 28 THEN total_s ELSE
      least((SELECT arg_min(f.frame, (f.rms, f.frame)) FROM fr_ f WHERE f.rec = wk.rec
        AND f.frame >= greatest(0, least(floor(end_s + 20)::BIGINT, n - 1)) AND f.frame < greatest(least(floor(end_s + 20)::BIGINT, n - 1) + 1, least(floor(end_s + 28)::BIGINT, n)))::DOUBLE, end_s + 28) END, total_s, n
  FROM wk WHERE end_s < total_s)"""


@query("win4_plan_spans", with_(WALK, body="SELECT rec, index, start_s, end_s FROM wk WHERE index >= 0", recursive=True))
def win4(spark, sf):
    from lexspan.operators.ordered import ordered

    e = table(spark, sf, "events").select(F.col("user_id").alias("rec"), "ts", "event_id", F.col("value").alias("rms"))
    # one block per day and recording
    frames = ordered(e, ["rec"], ["ts", "event_id"], F.to_date("ts"), position="frame").select("rec", "frame", "rms")
    lengths = frames.groupBy("rec").agg(F.count(F.lit(1)).cast("double").alias("total_s"))
    return P.plan_spans(frames, lengths, 1.0)


# --- notes and coverage ----------------------------------------------------------------
@query("arr1_span_range", with_(SPANS, body="SELECT note_id, first_span, last_span FROM ranged"))
def arr1(spark, sf):
    return ranged_notes(spark, sf).select("note_id", "first_span", "last_span")


@query("jn6_note_span_range", with_(SPANS, body="SELECT note_id, r.lecture_id, s.index FROM ranged r JOIN spans s ON s.lecture_id = r.lecture_id AND s.index BETWEEN first_span AND last_span"))
def jn6(spark, sf):
    return V.notes_in_range(ranged_notes(spark, sf), spans(spark, sf).select("lecture_id", "index")).select("note_id", "lecture_id", "index")


@query("jn7_note_times", with_(SPANS, body="""SELECT note_id, a.start_s, b.end_s FROM ranged r LEFT JOIN spans a ON a.lecture_id = r.lecture_id AND a.index = first_span
  LEFT JOIN spans b ON b.lecture_id = r.lecture_id AND b.index = last_span"""))
def jn7(spark, sf):
    n = ranged_notes(spark, sf).select("note_id", "lecture_id", "first_span", "last_span")
    return V.note_times(n, spans(spark, sf)).select("note_id", "start_s", "end_s")


@query("agg7_majority_vote", with_(SPANS, """h_ AS (SELECT note_id, r.subject_id, s.index, u AS unit_id, pos FROM ranged r JOIN spans s ON s.lecture_id = r.lecture_id AND s.index BETWEEN first_span AND last_span,
    unnest(retrieved_unit_ids) WITH ORDINALITY t(u, pos)),
v_ AS (SELECT note_id, unit_id, count(*) AS votes, min((index, pos)) AS seen FROM h_ JOIN units USING (subject_id, unit_id) GROUP BY ALL),
w_ AS (SELECT note_id, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY votes DESC, seen) AS rn FROM v_) WHERE rn = 1)""",
    body="""SELECT note_id, coalesce(w_.unit_id, u.unit_id) AS unit_id FROM ranged r LEFT JOIN w_ USING (note_id)
      LEFT JOIN (SELECT subject_id, unit_key, arg_max(unit_id, (order_index, unit_id)) AS unit_id FROM units GROUP BY subject_id, unit_key) u
        ON u.subject_id = r.subject_id AND u.unit_key = trim(coalesce(suggested_unit_key, ''))"""))
def agg7(spark, sf):
    n = ranged_notes(spark, sf).drop("unit_id")
    return V.attribute_units(n, spans(spark, sf), units(spark, sf)).select("note_id", "unit_id")


COVER = SPANS + """,
nl_ AS (SELECT n.*, l.lecture_title FROM notes n JOIN lectures l USING (lecture_id)),
uc_ AS (SELECT u.*, count(n.note_id) AS note_count FROM units u LEFT JOIN nl_ n ON n.unit_id = u.unit_id AND n.subject_id = u.subject_id GROUP BY ALL)"""


@query("jn8_unit_links", with_(COVER, body="""SELECT u.subject_id, u.unit_id, u.unit_key, u.title, note_id, lecture_id, topic, start_s, lecture_title FROM units u
  LEFT JOIN nl_ n ON n.unit_id = u.unit_id AND n.subject_id = u.subject_id"""))
def jn8(spark, sf):
    return V.unit_links(units(spark, sf), lectures(spark, sf), notes(spark, sf))


@query("agg6_unit_coverage", with_(COVER, body="SELECT subject_id, unit_id, unit_key, title, order_index, note_count, note_count > 0 AS covered FROM uc_"))
def agg6_units(spark, sf):
    return V.unit_coverage(units(spark, sf), lectures(spark, sf), notes(spark, sf))


@query("agg6_subject_coverage", with_(COVER, body="""SELECT s.subject_id, s.subject_name, count(uc_.unit_id) AS total_units, count(*) FILTER (note_count > 0) AS covered_units,
    CASE WHEN count(uc_.unit_id) > 0 THEN round_even(count(*) FILTER (note_count > 0) / count(uc_.unit_id)::DOUBLE, 4) END AS coverage_fraction,
    (SELECT count(*) FROM notes n WHERE n.unit_id IS NULL AND n.subject_id = s.subject_id) AS unattributed_notes
  FROM subjects s LEFT JOIN uc_ ON uc_.subject_id = s.subject_id AND s.subject_id <> 4 GROUP BY s.subject_id, s.subject_name"""))
def agg6(spark, sf):
    return V.subject_coverage(subjects(spark, sf), units(spark, sf).filter("subject_id <> 4"), lectures(spark, sf), notes(spark, sf))


@query("txt24_coverage_sentence", with_(COVER, """l_ AS (SELECT subject_id, count(*) AS t, count(*) FILTER (note_count > 0) AS d, string_agg(title, ', ' ORDER BY order_index) FILTER (note_count > 0) AS done,
    string_agg(title, ', ' ORDER BY order_index) FILTER (note_count = 0) AS rest FROM uc_ WHERE subject_id <> 4 GROUP BY subject_id)""",
    body="""SELECT s.subject_id, CASE WHEN t IS NULL THEN 'No syllabus has been uploaded for this subject yet, so I can''t tell you what''s been covered. Upload the syllabus PDF and I''ll track it against your lectures.'
    ELSE printf('**%d of %d syllabus units covered.**', d, t) || chr(10) || chr(10) || '**Covered:** ' || coalesce(done, 'nothing yet') || chr(10) || chr(10) || '**Outstanding:** ' || coalesce(rest, 'nothing — the syllabus is complete') END AS answer
    FROM subjects s LEFT JOIN l_ USING (subject_id)"""))
def txt24(spark, sf):
    return V.coverage_sentence(subjects(spark, sf), units(spark, sf).filter("subject_id <> 4"), lectures(spark, sf), notes(spark, sf))


WORDS = """tw_ AS (SELECT note_id, lecture_id, list_filter(string_split(markdown, ' '), lambda w: ends_with(w, '.')) AS ws FROM notes),
terms_ AS (SELECT DISTINCT note_id, lecture_id, w AS term, 'means ' || w AS definition FROM tw_, unnest(ws) t(w)),
outs_ AS (SELECT note_id, lecture_id, 'Explain ' || topic AS text, CASE WHEN note_id % 2 = 0 THEN 'apply' END AS bloom_level FROM notes WHERE note_id % 5 <> 0)"""


def terms_and_outcomes(spark, sf):
    n = notes(spark, sf)
    w = n.select("note_id", "lecture_id", F.explode(F.filter(F.split("markdown", " "), lambda x: F.endswith(x, F.lit(".")))).alias("term")).distinct()
    o = n.filter("note_id % 5 <> 0").select("note_id", "lecture_id", F.concat(F.lit("Explain "), "topic").alias("text"), F.when(F.col("note_id") % 2 == 0, "apply").alias("bloom_level"))
    return w.withColumn("definition", F.concat(F.lit("means "), "term")), o


def nested(spark, sf):
    t, o = terms_and_outcomes(spark, sf)
    return V.nest_notes(notes(spark, sf).select("note_id", "lecture_id", "topic"), t, o)


@query("arr2_nested_notes", with_(SPANS, WORDS, body="""SELECT n.note_id, n.lecture_id, n.topic, (SELECT coalesce(string_agg(term || '=' || definition, ';' ORDER BY term COLLATE "C"), '') FROM terms_ t WHERE t.note_id = n.note_id) AS terms,
  (SELECT coalesce(string_agg(text || '=' || coalesce(bloom_level, '-'), ';'), '') FROM outs_ o WHERE o.note_id = n.note_id) AS outcomes FROM notes n""".replace(' COLLATE "C"', "")))
def arr2(spark, sf):
    text = lambda c, a, b: F.array_join(F.transform(c, lambda s: F.concat(s[a], F.lit("="), F.coalesce(s[b], F.lit("-")))), ";")
    return nested(spark, sf).select("note_id", "lecture_id", "topic", text("terms", "term", "definition").alias("terms"), text("outcomes", "text", "bloom_level").alias("outcomes"))


@query("arr2_flattened_terms", with_(SPANS, WORDS, body="SELECT * FROM terms_"))
def arr2_terms(spark, sf):
    return V.flatten_terms(nested(spark, sf))


@query("arr2_flattened_outcomes", with_(SPANS, WORDS, body="SELECT note_id, lecture_id, text, coalesce(bloom_level, 'understand') AS bloom_level FROM outs_"))
def arr2_outcomes(spark, sf):
    return V.flatten_outcomes(nested(spark, sf))


LINE = "printf('[span %d | %ds-%ds] %s', index, start_s::BIGINT, end_s::BIGINT, text)"


@query("txt23_render_transcript", with_(SPANS, body=f"SELECT lecture_id, index, {LINE} AS line FROM spans"))
def txt23(spark, sf):
    return V.render_transcript(spans(spark, sf))


@query("txt23_joined_transcript", with_(SPANS, body=f"SELECT lecture_id, count(*) AS n_lines, string_agg({LINE}, chr(10) ORDER BY index) AS text FROM spans GROUP BY lecture_id"))
def txt23_joined(spark, sf):
    return V.join_lines(V.render_transcript(spans(spark, sf)), "\n")


@query("txt23_render_units", with_(SPANS, body="""SELECT s.subject_id, coalesce(string_agg('- ' || unit_key || ': ' || title, chr(10) ORDER BY order_index), '(no syllabus attached to this subject)') AS units_text
  FROM subjects s LEFT JOIN units u ON u.subject_id = s.subject_id AND u.subject_id <> 4 GROUP BY s.subject_id"""))
def txt23_units(spark, sf):
    return V.render_units(subjects(spark, sf), units(spark, sf).filter("subject_id <> 4"))


@query("txt25_full_transcript", with_(SPANS, body="SELECT lecture_id, index, coalesce(text, '') AS line FROM spans"))
def txt25(spark, sf):
    return V.full_transcript(spans(spark, sf))


@query("txt25_joined_transcript", with_(SPANS, body="SELECT lecture_id, count(*) AS n_lines, string_agg(coalesce(text, ''), ' ' ORDER BY index) AS text FROM spans GROUP BY lecture_id"))
def txt25_joined(spark, sf):
    return V.join_lines(V.full_transcript(spans(spark, sf)), " ")


# lectures of one subject have no spans yet
@query("txt25_nested_transcript", with_(SPANS, body="""SELECT l.lecture_id, lecture_title AS title, CASE WHEN subject_id = 4 THEN 'queued' ELSE 'ready' END AS status, duration_s,
  coalesce(string_agg(text, ' ' ORDER BY index), '') AS text, count(index) AS n_spans,
  coalesce(string_agg(index || '|' || start_s::INT || '|' || end_s::INT || '|' || length(text) || '|' || array_to_string(retrieved_unit_ids, '+'), ';' ORDER BY index), '') AS spans
FROM lectures l LEFT JOIN spans s ON s.lecture_id = l.lecture_id AND subject_id <> 4 GROUP BY ALL"""))
def txt25_nested(spark, sf):
    lec = lectures(spark, sf).withColumn("status", F.when(F.col("subject_id") == 4, "queued").otherwise("ready"))
    own = spans(spark, sf).filter(F.col("lecture_id") % 5 != 4).select("lecture_id", "index", "start_s", "end_s", "text", "retrieved_unit_ids")
    shown = lambda x: F.concat_ws("|", x["index"].cast("string"), x["start_s"].cast("int").cast("string"), x["end_s"].cast("int").cast("string"), F.length(x["text"]).cast("string"), F.array_join(x["retrieved_unit_ids"], "+"))
    return V.nested_transcripts(lec, own).select(
        "lecture_id", "title", "status", "duration_s", "text", F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", shown), ";").alias("spans"))


# --- retrieval contexts -----------------------------------------------------------------
SCOPED = VECTORS + """,
sim_ AS (SELECT question_id, wants_notes, items.*, round_even(list_cosine_similarity(vector, items.embedding), 9) AS score
  FROM questions JOIN items USING (subject_id) WHERE only_lecture IS NULL OR only_lecture = items.lecture_id)"""
MERGED = SCOPED + """,
side_ AS (SELECT *, CASE WHEN (kind = 'note') = wants_notes THEN 0 ELSE 1 END AS source FROM sim_),
rk_ AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY score DESC, id) AS source_rank FROM side_),
mg_ AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(score, 0) DESC, source, source_rank) AS rank FROM rk_ WHERE source_rank <= CASE source WHEN 0 THEN 12 ELSE 6 END),
kept_ AS (SELECT * FROM mg_ WHERE rank <= 14)"""


@query("top3_vector_top_k", with_(SCOPED, body="SELECT question_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM sim_) WHERE rank <= 12"))
def top3(spark, sf):
    return R.vector_top_k(questions(spark, sf), items(spark, sf)).select("question_id", "id", "score", "rank")


@query("top4_merge_sources", with_(MERGED, body="SELECT question_id, id, kind, source, source_rank, score, rank FROM kept_"))
def top4(spark, sf):
    return R.gather(questions(spark, sf), items(spark, sf)).select("question_id", "id", "kind", "source", "source_rank", "score", "rank")


STAMP = "printf('%02d:%02d', trunc(coalesce(start_s, 0))::BIGINT // 60, trunc(coalesce(start_s, 0))::BIGINT % 60)"
BLOCKS = MERGED + f""",
src_ AS (SELECT question_id, string_agg('[' || rank || '] ' || coalesce(lecture_title, 'Untitled') || ' — ' || CASE WHEN kind = 'note' THEN 'notes' ELSE 'transcript' END || ' @ ' || {STAMP} || chr(10) || text,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS sources,
  string_agg(concat_ws('|', rank, kind, lecture_id, coalesce(lecture_title, ''), {STAMP}, coalesce(note_id::VARCHAR, '')), ';' ORDER BY rank) AS citations FROM kept_ GROUP BY question_id)"""


def cited(c):
    s = lambda v: F.coalesce(v.cast("string"), F.lit(""))
    return F.array_join(F.transform(c, lambda x: F.concat_ws("|", s(x["n"]), s(x["kind"]), s(x["lecture_id"]), s(x["lecture_title"]), s(x["timestamp"]), s(x["note_id"]))), ";")


# one question in five asks about a subject of which nothing is stored, one in seven only talks
LONELY = "ql_ AS (SELECT question_id, question_id % 5 = 1 AS lonely, CASE WHEN question_id % 7 = 3 THEN 'smalltalk' ELSE 'lookup' END AS query_type FROM questions)"


@query("txt20_render_sources", with_(BLOCKS, LONELY, body=f"""SELECT question_id, CASE WHEN query_type = 'smalltalk' OR lonely THEN NULL ELSE sources END AS sources,
  CASE WHEN query_type = 'smalltalk' OR lonely THEN '' ELSE coalesce(citations, '') END AS citations,
  CASE WHEN query_type = 'smalltalk' THEN 'chat' WHEN lonely OR sources IS NULL THEN '{R.NOTHING_FOUND.replace("'", "''")}' END AS answer FROM ql_ LEFT JOIN src_ USING (question_id)"""))
def txt20(spark, sf):
    q = questions(spark, sf)
    kind = F.when(F.col("question_id") % 7 == 3, "smalltalk").otherwise("lookup")
    hits = R.gather(q.filter("question_id % 5 <> 1"), items(spark, sf))
    out = R.question_sources(q.select("question_id", kind.alias("query_type"), F.lit("chat").alias("fixed_answer")), hits)
    return out.select("question_id", "sources", cited(F.col("citations")).alias("citations"), "answer")


@query("txt21_used_citations", with_(MERGED, f"""an_ AS (SELECT question_id, string_agg(CASE WHEN id % 4 = 0 AND question_id % 3 <> 0 THEN 'so [' || rank || '].' ELSE '' END, ' ') AS answer FROM kept_ GROUP BY question_id),
u_ AS (SELECT k.*, contains(answer, '[' || rank || ']') AS used FROM kept_ k JOIN an_ USING (question_id)),
f_ AS (SELECT *, bool_or(used) OVER (PARTITION BY question_id) AS any_used FROM u_)""",
    body=f"""SELECT question_id, string_agg(concat_ws('|', rank, kind, lecture_id, coalesce(lecture_title, ''), {STAMP}, coalesce(note_id::VARCHAR, '')), ';' ORDER BY rank) AS citations
      FROM f_ WHERE CASE WHEN any_used THEN used ELSE rank <= 3 END GROUP BY question_id"""))
def txt21(spark, sf):
    hits = R.gather(questions(spark, sf), items(spark, sf))
    answers = hits.groupBy("question_id").agg(F.array_join(F.collect_list(F.when(
        (F.col("id") % 4 == 0) & (F.col("question_id") % 3 != 0), F.concat(F.lit("so ["), F.col("rank").cast("string"), F.lit("].")))), " ").alias("answer"))
    out = R.render_sources(hits).join(answers, "question_id")
    return out.select("question_id", cited(R.used_citations(F.col("citations"), F.col("answer"))).alias("citations"))


@query("win5_recent_history", """WITH r AS (SELECT conv_id AS session_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT session_id, count(*) AS n_fetched, coalesce(string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) FILTER (rn <= 6), '(none)') AS convo FROM r WHERE rn <= 8 GROUP BY session_id""")
def win5(spark, sf):
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return R.recent_history(m).withColumn("convo", R.history_or_none(F.col("convo")))


HINTS = """lec_ AS (SELECT p_partkey AS lecture_id, p_brand AS subject_id, p_name AS title, p_partkey AS created_order FROM part),
q_ AS (SELECT o_orderkey AS question_id, 'Brand#' || (o_custkey % 25 + 1) AS subject_id,
  CASE o_orderkey % 6 WHEN 0 THEN ' Ring ' WHEN 1 THEN 'red' WHEN 2 THEN 'e b' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE o_orderpriority END AS lecture_hint FROM orders),
h_ AS (SELECT DISTINCT subject_id, trim(lower(lecture_hint)) AS hint FROM q_ WHERE trim(coalesce(lecture_hint, '')) <> ''),
m_ AS (SELECT h_.subject_id, hint, arg_min(lecture_id, created_order) AS lecture_id FROM h_ JOIN lec_ ON lec_.subject_id = h_.subject_id AND contains(lower(title), hint) GROUP BY ALL)"""


@query("jn14_resolve_hints", with_(HINTS, body="SELECT q_.question_id, q_.subject_id, q_.lecture_hint, m_.lecture_id FROM q_ LEFT JOIN m_ ON m_.subject_id = q_.subject_id AND hint = trim(lower(lecture_hint))"))
def jn14(spark, sf):
    lec = table(spark, sf, "part").select(F.col("p_partkey").alias("lecture_id"), F.col("p_brand").alias("subject_id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("created_order"))
    k = F.col("o_orderkey") % 6
    hint = F.when(k == 0, " Ring ").when(k == 1, "red").when(k == 2, "e b").when(k == 3, "").when(k == 5, F.col("o_orderpriority"))
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("subject_id"), hint.alias("lecture_hint"))
    return R.resolve_hints(q, lec)


@query("prj4_route_record", """SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN event_type ELSE 'lookup' END AS query_type, CASE WHEN event_type = 'view' THEN 'q' || event_id ELSE 'question ' || event_id END AS search_query,
  CASE WHEN event_type = 'error' THEN 'week ' || user_id ELSE '' END AS lecture_hint, event_type = 'click' AS wants_notes FROM events""")
def prj4(spark, sf):
    e = F.col("event_type")
    raw = F.to_json(F.struct(
        F.when(e.isin("click", "error"), e).alias("query_type"),
        F.when(e == "view", F.concat(F.lit("q"), F.col("event_id").cast("string"))).when(e == "click", "").alias("search_query"),
        F.when(e == "error", F.concat(F.lit("  week "), F.col("user_id").cast("string"), F.lit(" "))).alias("lecture_hint"), F.when(e == "click", True).alias("wants_notes")))
    raw = F.when(e == "signup", "not json").otherwise(raw)
    r = R.route_record(raw, F.concat(F.lit("question "), F.col("event_id").cast("string")))
    return table(spark, sf, "events").select("event_id", r.alias("r")).select("event_id", "r.*")


@query("txt22_note_documents", with_(SPANS, body="""SELECT 'note:' || note_id AS id, topic || chr(10) || chr(10) || markdown AS document, 'note' AS kind, n.subject_id, lecture_id, lecture_title, note_id, topic, coalesce(unit_id, '') AS unit_id,
  coalesce(start_s, 0) AS start_s, coalesce(end_s, 0) AS end_s FROM notes n JOIN lectures USING (lecture_id)"""))
def txt22(spark, sf):
    return R.note_documents(notes(spark, sf).drop("subject_id"), lectures(spark, sf))


# --- catalog -----------------------------------------------------------------------------
STATUS = "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END"
JOBS = f"jobs AS (SELECT o_orderkey AS id, o_custkey AS subject_id, o_orderkey % 100 AS lecture_id, {STATUS} AS status, o_orderdate AS created_at, o_orderpriority AS message FROM orders)"


def jobs(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject_id"), (F.col("o_orderkey") % 100).alias("lecture_id"),
                                             F.when(s == "O", "queued").when(s == "P", "running").otherwise("succeeded").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("message"))


@query("flt4_accepted_upload", """WITH n AS (SELECT event_id, 'rec.' || event_id || CASE event_id % 6 WHEN 0 THEN '.MP3' WHEN 1 THEN '.wav' WHEN 2 THEN '.pdf' WHEN 3 THEN '' WHEN 4 THEN '.m4a.txt' ELSE '.Opus' END AS name FROM events)
SELECT event_id, name, CASE event_id % 6 WHEN 0 THEN '.mp3' WHEN 1 THEN '.wav' WHEN 2 THEN '.pdf' WHEN 3 THEN '.' || event_id WHEN 4 THEN '.txt' ELSE '.opus' END AS suffix, event_id % 6 IN (0, 1, 5) AS accepted FROM n""")
def flt4(spark, sf):
    k = F.col("event_id") % 6
    ext = F.when(k == 0, ".MP3").when(k == 1, ".wav").when(k == 2, ".pdf").when(k == 3, "").when(k == 4, ".m4a.txt").otherwise(".Opus")
    n = table(spark, sf, "events").select("event_id", F.concat(F.lit("rec."), F.col("event_id").cast("string"), ext).alias("name"))
    return n.select("event_id", "name", C.file_suffix(F.col("name")).alias("suffix"), C.accepted_upload(F.col("name")).alias("accepted"))


@query("flt5_list_jobs", with_(JOBS, body="SELECT * FROM jobs WHERE status = 'running' ORDER BY created_at DESC, id LIMIT 200"))
def flt5(spark, sf):
    return C.list_jobs(jobs(spark, sf), status="running", limit=500)


@query("flt6_requeue_stale", with_(JOBS, body="SELECT * REPLACE (CASE WHEN status IN ('queued', 'running') THEN 'queued' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN 'requeued after restart' ELSE message END AS message) FROM jobs"))
def flt6(spark, sf):
    return C.requeue_stale(jobs(spark, sf))


@query("flt7_clamp_progress", "SELECT event_id, round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value - 20) / 299)), 4) AS progress FROM events")
def flt7(spark, sf):
    return table(spark, sf, "events").select("event_id", C.clamp_progress((F.col("value") - 20) / 299).alias("progress"))


@query("flt8_partial_update", """SELECT d.doc_id, CASE WHEN quality = 1 THEN 'good' ELSE lang END AS lang, CASE WHEN toxic = 1 THEN 'toxic' ELSE source END AS source, n_chars FROM documents d LEFT JOIN labels l USING (doc_id)""")
def flt8(spark, sf):
    p = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"), F.when(F.col("toxic") == 1, "toxic").alias("source"))
    return C.patch(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), p, "doc_id", ["lang", "source"])


@query("top7_newest_first", with_(JOBS, body="SELECT lecture_id, id, created_at FROM jobs ORDER BY lecture_id, created_at DESC, id"))
def top7(spark, sf):
    return C.newest_first(jobs(spark, sf), "created_at", "id", within="lecture_id").select("lecture_id", "id", "created_at")


@query("agg11_subject_listing", """SELECT c_custkey AS subject_id, c_name, count(o_orderkey) AS lecture_count, c_custkey IN (SELECT doc_id FROM documents WHERE lang = 'en') AS has_syllabus FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def agg11(spark, sf):
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), "c_name")
    s = C.with_child_count(s, jobs(spark, sf), "subject_id", "lecture_count")
    return C.with_presence(s, table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("subject_id")), "subject_id", "has_syllabus")


@query("agg11_session_listing", "SELECT user_id AS session_id, u.n AS updated, count(conv_id) AS message_count FROM (SELECT user_id, max(ts) AS n FROM events GROUP BY user_id) u LEFT JOIN conversations ON conv_id = user_id GROUP BY ALL")
def agg11_sessions(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("updated"))
    return C.with_child_count(s, table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id")), "session_id", "message_count")


DOOMED = "doomed AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"


@query("jn16_cascade_delete", with_(DOOMED, "o_ AS (SELECT * FROM orders WHERE o_custkey NOT IN (FROM doomed))", body="""SELECT 'customer' AS tbl, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer WHERE c_custkey NOT IN (FROM doomed)
  UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o_ UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM doomed))"""))
def jn16(spark, sf):
    t = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem")}
    left = C.delete_cascade(t, t["customer"].filter("c_acctbal < 0").select("c_custkey"), "customer",
                            [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")])
    key = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    out = [left[n].agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("ids")).select(F.lit(n).alias("tbl"), "n", "ids") for n, k in key.items()]
    return out[0].union(out[1]).union(out[2])


@query("jn17_null_dangling", "SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey")
def jn17(spark, sf):
    return C.null_dangling(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf, "customer").filter("c_acctbal >= 0"), "c_custkey")


@query("set4_upsert", "SELECT doc_id, lang AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'label ' || quality FROM labels")
def set4(spark, sf):
    new = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string")).alias("v"))
    return C.upsert(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("v")), new, "doc_id")


@query("set5_replace_by_key", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def set5(spark, sf):
    new = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("o_totalprice").alias("l_quantity"))
    return C.replace_by_key(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), new, "l_orderkey")


@query("win8_unit_keys", "SELECT l_orderkey, l_linenumber, substr('order-' || l_orderkey || '-syllabus', 1, 12) || printf('-u%02d', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS unit_key FROM lineitem")
def win8(spark, sf):
    prefix = F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"), F.lit("-syllabus"))
    lines = table(spark, sf, "lineitem").withColumn("prefix", prefix)
    keyed = C.number_units(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("prefix"))
    return keyed.select("l_orderkey", "l_linenumber", "unit_key")


@query("jsn1_json_columns", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, '{\"k\":' || (props::JSON ->> '$.k') || ',\"type\":\"' || event_type || ' é\"}' AS written FROM events")
def jsn1(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", C.read_json(F.col("props"), "k long").alias("p"))
    return e.select("event_id", "p.k", C.write_json(F.struct(F.col("p.k").alias("k"), F.concat("event_type", F.lit(" é")).alias("type"))).alias("written"))


# citations of an event, nested, with text outside ASCII; every seventh text is broken, every ninth is null
@query("jsn1_nested_citations", """WITH e AS (SELECT event_id, user_id, event_type, event_id % 7 = 0 AS broken, event_id % 9 = 0 AS absent FROM events)
SELECT event_id, CASE WHEN absent THEN 'null' WHEN broken THEN 'broken' ELSE 'ok' END AS state, CASE WHEN NOT absent AND NOT broken THEN pos::INT END AS pos,
  CASE WHEN NOT absent AND NOT broken THEN event_type || ' é समझ ' || pos END AS title, CASE WHEN NOT absent AND NOT broken THEN user_id + pos END AS lecture,
  CASE WHEN NOT absent AND NOT broken AND pos = 0 THEN 2.5::DOUBLE END AS start_s
FROM e, unnest(range(0, CASE WHEN absent OR broken THEN 1 ELSE event_id % 3 END)) t(pos)""")
def jsn1_nested(spark, sf):
    e = table(spark, sf, "events")
    cite = lambda i: F.struct((F.col("user_id") + i).alias("lecture"), F.concat("event_type", F.lit(" é समझ "), i.cast("string")).alias("title"), F.when(i == 0, 2.5).alias("start_s"))
    cites = F.transform(F.filter(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")), lambda i: i < F.col("event_id") % 3), cite)
    text = C.write_json(F.struct(F.col("event_id").alias("id"), cites.alias("citations")))
    raw = F.when(F.col("event_id") % 9 == 0, None).when(F.col("event_id") % 7 == 0, F.concat(text, F.lit("]"))).otherwise(text)
    rows = e.select("event_id", raw.alias("raw")).select("event_id", C.broken_json(F.col("raw")).alias("broken"), F.col("raw").isNull().alias("absent"), C.json_value(F.col("raw")).alias("v"))
    got = C.json_elements(rows, ["event_id"], "v", "$.citations").select(
        "event_id", F.lit("ok").alias("state"), "pos", *[C.json_path(F.col("element"), f"$.{p}", k).alias(p) for p, k in (("title", "string"), ("lecture", "bigint"), ("start_s", "double"))])
    odd = rows.filter("broken OR absent").select("event_id", F.when(F.col("absent"), "null").otherwise("broken").alias("state"))
    return got.unionByName(odd, allowMissingColumns=True)


@query("dat1_parse_iso", """WITH t AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%d/%m/%Y') ELSE '2024-13-' || (event_id % 10) END AS raw FROM events)
SELECT event_id, raw, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts)::TIMESTAMP END AS parsed, event_id % 4 >= 2 AS rejected FROM t""")
def dat1(spark, sf):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy-MM-dd")).when(k == 2, F.date_format("ts", "dd/MM/yyyy")).otherwise(
        F.concat(F.lit("2024-13-"), (F.col("event_id") % 10).cast("string")))
    parsed, rejected = C.parse_iso(F.col("raw"))
    return table(spark, sf, "events").select("event_id", raw.alias("raw")).select("event_id", "raw", parsed.alias("parsed"), rejected.alias("rejected"))


# --- quality rules --------------------------------------------------------------------------
PROV = "['real', 'generated-from-title', 'oracle', 'copied'][(doc_id % 4 + 1)::INT]"


@query("dq1_validate_units", with_(SYLLABI, f"""m_ AS (SELECT u.*, {mixed_script_sql('prose', 'unit_order % 2 = 1')} AS mx FROM units_ u),
n_ AS (SELECT *, {norm_sql("prose || ' ' || mx")} AS n FROM m_), w_ AS (SELECT *, {words_sql('n')} AS w, len({tokens_sql("prose || ' ' || mx")}) AS t FROM n_),
s_ AS (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '[\\x{{900}}-\\x{{97f}}]'))) AS d, len(list_filter(w, lambda x: NOT regexp_matches(x, '[\\x{{900}}-\\x{{97f}}]') AND regexp_matches(x, '[a-z]'))) AS l,
    min(unit_order) OVER (PARTITION BY course_id, unit_id) AS first_order FROM w_),
i_ AS (SELECT course_id, unit_id, unit_order, unnest(list_filter([
    CASE WHEN t NOT BETWEEN 60 AND 105 THEN 'prose ' || t || ' tokens (want 60-105)' END, CASE WHEN len(keywords) NOT BETWEEN 5 AND 12 THEN len(keywords) || ' keywords (want 6-10)' END,
    CASE WHEN first_order < unit_order THEN 'duplicate unit_id' END,
    CASE WHEN len(w) = 0 OR d < 0.25 * len(w) OR l < 0.15 * len(w) THEN 'script mix: prose should be genuinely code-mixed' END], lambda x: x IS NOT NULL)) AS issue FROM s_)""",
    body="SELECT course_id, unit_id, unit_order::INT AS unit_order, issue FROM i_"))
def dq1(spark, sf):
    u = T.explode_units(syllabi(spark, sf))
    u = u.withColumn("prose", F.concat("prose", F.lit(" "), mixed_script(F.col("prose"), F.col("unit_order") % 2 == 1)))
    return Q.validate_units(u)


@query("dq1_validate_courses", with_(SYLLABI, f"c_ AS (SELECT 'c' || doc_id AS course_id, {PROV} AS p, CASE WHEN doc_id % 8 = 0 THEN source END AS url, len(ls) AS n FROM docs_)",
    body="""SELECT course_id, unnest(list_filter([CASE WHEN p = 'copied' THEN 'bad provenance copied' END, CASE WHEN p = 'real' AND url IS NULL THEN 'provenance=''real'' but no source_url' END,
      CASE WHEN n NOT BETWEEN 6 AND 12 THEN n || ' units (want 6-12)' END], lambda x: x IS NOT NULL)) AS issue FROM c_"""))
def dq1_courses(spark, sf):
    return Q.validate_courses(syllabi(spark, sf))


@query("dq2_leakage", f"""WITH u AS (SELECT 'c' || doc_id AS course_id, {PROV} AS provenance, cond FROM documents, (VALUES ('C4'), ('C6')) v(cond))
SELECT * FROM (SELECT *, CASE WHEN provenance = 'oracle' AND cond <> 'C6' THEN 'oracle provenance in a scored condition' WHEN provenance = 'copied' THEN 'unrecognised provenance' END AS problem FROM u) WHERE problem IS NOT NULL""")
def dq2(spark, sf):
    uses = syllabi(spark, sf).select("course_id", "provenance", F.explode(F.array(F.lit("C4"), F.lit("C6"))).alias("cond"))
    return Q.leakage_violations(uses)


@query("dq6_missing_fields", with_(SYLLABI, body="""SELECT 'c' || doc_id AS course_id, 'missing required field ''title''' AS issue FROM documents WHERE doc_id % 10 = 3
  UNION ALL SELECT course_id, 'unit missing ''prose''' FROM units_ WHERE prose = ''"""))
def dq6(spark, sf):
    c = syllabi(spark, sf).withColumn("units", F.transform("units", lambda u: u.withField("prose", F.nullif(u["prose"], F.lit("")))))
    return Q.missing_fields(c)
