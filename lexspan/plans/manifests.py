"""Corpus, manifest, sampling and course queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.functions.seeded import seeded_hash
from lexspan.operators import manifest as M
from lexspan.operators import spans as P
from lexspan.plans.base import (
    CORPUS, UTTS, corpus, hash_sql, hypotheses, query, table, tokens_sql, utt_block, utterances, with_,
)
from lexspan.session import durable
from lexspan.sources import kaldi as K
from lexspan.sources import tables as T


# --- corpus files as lines ------------------------------------------------------
@query("src1_kaldi_text", with_(UTTS, body="SELECT utt_id AS utt, trim(ref) AS transcript FROM utts"))
def src1_text(spark, sf):
    u = utterances(spark, sf)
    lines = u.select(F.explode(F.array(F.concat_ws(" ", "utt_id", F.concat(F.lit(" "), "ref", F.lit("  "))), F.lit("   "))).alias("value"))
    return K.parse_text(lines)


@query("src1_kaldi_wavscp", """SELECT printf('%08d', c_custkey) AS rec, '/audio/' || c_name || '.wav' AS path FROM customer WHERE c_custkey % 3 <> 2""")
def src1_wavscp(spark, sf):
    c = table(spark, sf, "customer")
    wav = F.concat(F.lit("/audio/"), "c_name", F.lit(".wav"))
    rest = F.when(F.col("c_custkey") % 3 == 0, wav).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("sox "), wav, F.lit(" -t raw - |"))).otherwise("missing")
    return K.parse_wavscp(c.select(F.concat_ws(" ", F.format_string("%08d", "c_custkey"), rest).alias("value")))


@query("src1_kaldi_segments", with_(UTTS, body="""SELECT utt_id AS utt, lecture_id AS rec, "start", "end" FROM utts"""))
def src1_segments(spark, sf):
    u = utterances(spark, sf)
    return K.parse_segments(u.select(F.concat_ws("  ", "utt_id", "lecture_id", F.col("start").cast("string"), F.col("end").cast("string")).alias("value")))


@query("src2_whole_recordings", """SELECT doc_id::VARCHAR AS utt, doc_id::VARCHAR AS rec, 0.0::DOUBLE AS start, (floor(value * 16000) / 16000)::DOUBLE AS end
  FROM documents JOIN events ON doc_id = event_id WHERE event_type <> 'error'""")
def src2(spark, sf):
    text = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("utt"), F.col("text").alias("transcript"))
    e = table(spark, sf, "events").withColumn("rec", F.col("event_id").cast("string"))
    lengths = e.select("rec", F.floor(F.col("value") * 16000).alias("frames"), F.lit(16000).alias("samplerate"))
    return K.fill_open_ends(K.whole_recordings(text, e.filter("event_type <> 'error'").select("rec")), lengths)


BASE_PACKED = UTTS + f""",
base_ AS (SELECT utt_id, ref, CASE WHEN role = 'user' THEN 'dev' ELSE 'test' END AS split,
  CASE {hash_sql('utt_id')} % 3 WHEN 0 THEN true WHEN 1 THEN false END AS in_eval, NULL::INT AS n_segments FROM utts),
packed_ AS (SELECT lecture_id || '+' || count(*) AS utt_id, min(ref) AS ref, 'test' AS split, true AS in_eval, count(*)::INT AS n_segments FROM utts GROUP BY lecture_id)"""


def base_and_packed(spark, sf):
    u = utterances(spark, sf)
    h = seeded_hash(F.col("utt_id")) % 3
    base = u.select("utt_id", "ref", F.when(F.col("role") == "user", "dev").otherwise("test").alias("split"),
                    F.when(h == 0, True).when(h == 1, False).alias("in_eval"))
    n = F.count(F.lit(1))
    packed = u.groupBy("lecture_id").agg(F.min("ref").alias("ref"), n.cast("int").alias("n_segments")).select(
        F.concat("lecture_id", F.lit("+"), F.col("n_segments").cast("string")).alias("utt_id"), "ref", F.lit("test").alias("split"),
        F.lit(True).alias("in_eval"), "n_segments")
    return base, packed


@query("src3_manifest_rows", with_(
    BASE_PACKED, body="SELECT * FROM (SELECT * FROM base_ UNION ALL SELECT * FROM packed_) WHERE split = 'test' AND coalesce(in_eval, true)"))
def src3(spark, sf):
    return T.select_split(T.union_manifests(*base_and_packed(spark, sf)), "test")


# every eleventh line is cut, every thirteenth lacks its split, every seventeenth has a word for a number
@query("src3_manifest_rejects", with_(BASE_PACKED, f"""n_ AS (SELECT utt_id, split, {hash_sql("'line'", 'utt_id')} AS h FROM base_)""",
    body="""SELECT utt_id, CASE WHEN h % 11 = 0 OR h % 17 = 0 THEN 'not a JSON record' WHEN h % 13 = 0 THEN 'missing split' END AS problem,
  CASE WHEN h % 11 <> 0 AND h % 17 <> 0 AND h % 13 <> 0 THEN split END AS split FROM n_"""))
def src3_rejects(spark, sf):
    base, _ = base_and_packed(spark, sf)
    h = seeded_hash("line", F.col("utt_id"))
    row = F.struct("utt_id", "ref", F.when(h % 13 != 0, F.col("split")).alias("split"), F.when(h % 17 == 0, "many").otherwise("3").alias("n_segments"))
    text = F.regexp_replace(F.to_json(row), '"n_segments":"3"', '"n_segments":3')
    lines = base.select("utt_id", F.when(h % 11 == 0, F.substr(text, F.lit(1), F.length(text) - 3)).otherwise(text).alias("value"))
    checked = T.checked_records(lines, T.MANIFEST, T.MANIFEST_FIELDS)
    return checked.select("utt_id", "problem", F.when(F.col("problem").isNull(), F.col("record.split")).alias("split"))


@query("set1_union_manifests", with_(BASE_PACKED, body="SELECT * FROM base_ UNION ALL SELECT * FROM packed_"))
def set1(spark, sf):
    return T.union_manifests(*base_and_packed(spark, sf))


# a document is a course, its lines are the units
SYLLABI = """docs_ AS (SELECT *, string_split(text, chr(10)) AS ls FROM documents),
units_ AS (SELECT 'c' || doc_id AS course_id, i - 1 AS unit_order, 'c' || doc_id || '-u' || (CASE WHEN i % 40 = 0 THEN 1 ELSE i END) AS unit_id, 'line ' || i AS title,
  ls[i] AS prose, string_split(ls[i], ' ') AS keywords FROM docs_, unnest(range(1, len(ls) + 1)) t(i))"""


def syllabi(spark, sf):
    cid = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    unit = lambda l, i: F.struct(
        F.concat(cid, F.lit("-u"), F.when((i + 1) % 40 == 0, F.lit(1)).otherwise(i + 1).cast("string")).alias("unit_id"),
        F.concat(F.lit("line "), (i + 1).cast("string")).alias("title"), l.alias("prose"), F.split(l, " ").alias("keywords"))
    return table(spark, sf, "documents").select(
        cid.alias("course_id"), F.when(F.col("doc_id") % 10 != 3, F.col("source")).alias("title"),
        F.element_at(F.array(*[F.lit(p) for p in ("real", "generated-from-title", "oracle", "copied")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("provenance"),
        F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("https://"), "source")).alias("source_url"), F.transform(F.split("text", "\n"), unit).alias("units"))


@query("src4_syllabus_units", with_(
    SYLLABI, body="SELECT course_id, unit_order::INT AS unit_order, unit_id, title, prose, array_to_string(keywords, '|') AS keywords FROM units_"))
def src4(spark, sf):
    text = syllabi(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    u = T.explode_units(T.parse_syllabi(text))
    return u.withColumn("keywords", F.array_join("keywords", "|"))


@query("src5_pending_sets", """SELECT DISTINCT lang AS model, source AS cond, (doc_id % 7)::BIGINT AS split FROM documents
  EXCEPT SELECT lang, source, (doc_id % 7)::BIGINT FROM documents JOIN labels USING (doc_id) WHERE quality = 1""")
def src5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("model"), F.col("source").alias("cond"), (F.col("doc_id") % 7).alias("split"))
    stored = d.join(table(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi")
    return T.pending_sets(d, stored, T.HYP_KEYS)


SCORE_ROWS = """scores_ AS (SELECT o_orderstatus AS model, o_orderpriority AS cond, year(o_orderdate)::VARCHAR AS split, count(*) AS n,
  round_even(avg(o_totalprice) / 1e6, 6) AS wer, CASE WHEN count(*) % 3 <> 0 THEN round_even(avg(o_totalprice) / 3e6, 6) END AS wer_sa FROM orders GROUP BY ALL)"""


def order_scores(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("cond"),
                                           F.year("o_orderdate").cast("string").alias("split"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("o_totalprice") / 1e6, 6).alias("wer"), F.avg("o_totalprice").alias("a")).select(
        "model", "cond", "split", "n", "wer", F.when(F.col("n") % 3 != 0, F.bround(F.col("a") / 3e6, 6)).alias("wer_sa"))


@query("src6_score_lines", with_(SCORE_ROWS, body="SELECT model, cond, split, n, wer, wer_sa, NULL::DOUBLE AS cer FROM scores_"))
def src6(spark, sf):
    s = order_scores(spark, sf)
    names = [f.split() for f in T.SCORES.split(", ")]
    full = s.select(*[F.col(n) if n in s.columns else F.lit(None).cast(t).alias(n) for n, t in names])
    return T.parse_score_lines(T.score_lines(full)).select("model", "cond", "split", "n", "wer", "wer_sa", "cer")


@query("src6_contrast_documents", with_(SCORE_ROWS, body="""SELECT 'C0->' || model || cond || split AS contrast, n::DOUBLE AS n, wer AS corpus_delta,
  wer - 1 AS ci_low, wer + 1 AS ci_high FROM scores_"""))
def src6_stats(spark, sf):
    s = order_scores(spark, sf)
    d = lambda c: c.cast("double")
    full = s.select(F.concat(F.lit("C0->"), "model", "cond", "split").alias("contrast"), d(F.col("n")).alias("n"), F.col("wer").alias("corpus_delta"),
                    F.array(F.col("wer") - 1, F.col("wer") + 1).alias("ci"), F.lit(0.5).alias("p_improve"), F.col("wer").alias("macro_delta"),
                    F.array(F.col("wer"), F.col("wer")).alias("macro_ci"), F.lit(0.1).alias("degraded"), F.lit(0.2).alias("improved"))
    c = T.parse_contrasts(T.contrast_lines(full))
    return c.select("contrast", "n", "corpus_delta", c["ci"][0].alias("ci_low"), c["ci"][1].alias("ci_high"))


@query("src7_discover", """WITH l AS (SELECT url || '#' || page_id AS file, string_split(html, '<p>') AS ls FROM pages)
  SELECT file, len(ls) AS n_lines, array_to_string(ls[1:5], chr(10)) AS head FROM l""")
def src7(spark, sf):
    lines = table(spark, sf, "pages").select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("file"),
                                             F.posexplode(F.split("html", "<p>")).alias("line_no", "value"))
    return K.discover(lines).withColumn("head", F.array_join("head", "\n"))


@query("agg9_prefix_groups", with_(
    UTTS, body=r"""SELECT 'strip last field' AS grouping, prefix, n_ids FROM (SELECT regexp_extract(utt_id, '^(.*)_[^_]+$', 1) AS prefix, count(*) AS n_ids FROM utts GROUP BY 1 ORDER BY n_ids DESC, prefix LIMIT 10)
  UNION ALL SELECT 'first field', prefix, n_ids FROM (SELECT regexp_extract(c_name, '^([^_]+)', 1) AS prefix, count(*) AS n_ids FROM customer GROUP BY 1 ORDER BY n_ids DESC, prefix LIMIT 10)"""))
def agg9(spark, sf):
    a = K.prefix_groups(utterances(spark, sf), "utt_id", K.LAST_FIELD_PREFIX).select(F.lit("strip last field").alias("grouping"), "prefix", "n_ids")
    b = K.prefix_groups(table(spark, sf, "customer"), "c_name", K.FIRST_FIELD_PREFIX).select(F.lit("first field").alias("grouping"), "prefix", "n_ids")
    return a.union(b)


# --- reject rules, splits, samples ---------------------------------------------------
@query("jn1_corpus_join", with_(CORPUS, body="SELECT * FROM joined"))
def jn1(spark, sf):
    return M.join_corpus(*corpus(spark, sf))


@query("flt1_reject_reason", with_(CORPUS, body="SELECT utt, reason FROM flagged"))
def flt1(spark, sf):
    return M.with_reject_reason(M.join_corpus(*corpus(spark, sf))).select("utt", "reason")


@query("flt1_survivors", with_(CORPUS, body="SELECT * FROM kept"))
def flt1_survivors(spark, sf):
    return manifest_rows(spark, sf)


@query("flt2_skip_report", with_(CORPUS, body="SELECT reason, count(*) AS n FROM flagged WHERE reason IS NOT NULL GROUP BY reason"))
def flt2(spark, sf):
    return M.skip_report(M.with_reject_reason(M.join_corpus(*corpus(spark, sf))))


def manifest_rows(spark, sf):
    return M.survivors(M.with_reject_reason(M.join_corpus(*corpus(spark, sf))))


SPLIT = CORPUS + f""",
lecs_ AS (SELECT lecture_id, row_number() OVER (ORDER BY md5(concat_ws('-', 1337, lecture_id)), lecture_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT lecture_id FROM kept)),
split_ AS (SELECT kept.*, CASE WHEN place < greatest(1, floor(n * 0.3::DOUBLE)) THEN 'dev' ELSE 'test' END AS split FROM kept JOIN lecs_ USING (lecture_id)),
titled AS (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY utt_id) <= 2 AS title_source FROM split_)"""


def titled_rows(spark, sf):
    return M.mark_title_source(M.lecture_split(manifest_rows(spark, sf)))


@query("win6_lecture_split", with_(SPLIT, body="SELECT lecture_id, split, count(*) AS n FROM split_ GROUP BY ALL"))
def win6(spark, sf):
    return M.lecture_split(manifest_rows(spark, sf)).groupBy("lecture_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query("win1_title_source", with_(SPLIT, body="SELECT utt_id, title_source FROM titled"))
def win1(spark, sf):
    return titled_rows(spark, sf).select("utt_id", "title_source")


def sample_ctes(split: str, n: int, name: str, source: str = "titled", where: str = "NOT title_source") -> str:
    return f"""{name}_p AS (SELECT * FROM {source} WHERE split = '{split}' AND {where}),
{name}_c AS (SELECT lecture_id, count(*) AS c, sum(count(*)) OVER () AS total FROM {name}_p GROUP BY lecture_id),
{name}_q AS (SELECT *, floor({n} * c / total::DOUBLE) AS fl, {n} * c / total::DOUBLE - floor({n} * c / total::DOUBLE) AS rem FROM {name}_c),
{name}_r AS (SELECT *, row_number() OVER (ORDER BY rem DESC, lecture_id) - 1 AS place, sum(fl) OVER () AS fls FROM {name}_q),
{name}_k AS (SELECT lecture_id, CASE WHEN total <= {n} THEN c ELSE fl + (place < {n} - fls)::INT END AS quota FROM {name}_r),
{name} AS (SELECT utt_id FROM (SELECT utt_id, lecture_id, row_number() OVER (PARTITION BY lecture_id ORDER BY md5(concat_ws('-', 1337, utt_id)), utt_id) AS rn FROM {name}_p)
  JOIN {name}_k USING (lecture_id) WHERE rn <= quota)"""


@query("win7_stratified_sample", with_(SPLIT, sample_ctes("dev", 60, "dev"), sample_ctes("test", 150, "tst"),
                                       body="SELECT utt_id FROM dev UNION ALL SELECT utt_id FROM tst"))
def win7(spark, sf):
    rows = durable(titled_rows(spark, sf).filter("NOT title_source").select("utt_id", "lecture_id", "split"))
    return M.stratified_sample(rows.filter("split = 'dev'"), 60).select("utt_id").union(
        M.stratified_sample(rows.filter("split = 'test'"), 150).select("utt_id"))


@query("win7_stratified_documents", with_(
    "src_ AS (SELECT doc_id::VARCHAR AS utt_id, source || '-' || lang AS lecture_id, 'all' AS split FROM documents)",
    sample_ctes("all", 200, "smp", "src_", "true"), body="SELECT utt_id FROM smp"))
def win7_docs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("utt_id"), F.concat_ws("-", "source", "lang").alias("lecture_id"))
    return M.stratified_sample(d, 200).select("utt_id")


MANIFEST = with_(SPLIT, sample_ctes("dev", 60, "dev"), sample_ctes("test", 150, "tst"),
                 "ids_ AS (SELECT utt_id FROM dev UNION SELECT utt_id FROM tst)",
                 "manifest_ AS (SELECT titled.*, ids_.utt_id IS NOT NULL AS in_eval FROM titled LEFT JOIN ids_ USING (utt_id))", body="")


def manifest(spark, sf):
    return M.build_manifest(*corpus(spark, sf))


@query("set3_in_eval_flag", MANIFEST + "SELECT utt_id, split, in_eval FROM manifest_")
def set3(spark, sf):
    return manifest(spark, sf).select("utt_id", "split", "in_eval")


@query("agg10_manifest_summary", MANIFEST + """SELECT split, in_eval, count(*) AS n, round_even(sum(dur) / 3600, 6) AS hours, round_even(sum(dur) / 60, 6) AS minutes,
  round_even(avg(dur), 6) AS mean_dur, round_even(quantile_cont(dur, 0.5), 6) AS median_dur FROM manifest_ GROUP BY GROUPING SETS ((split, in_eval), (split), ())""")
def agg10(spark, sf):
    return M.manifest_summary(manifest(spark, sf))


PACK = UTTS + f""",
seg_ AS (SELECT utt_id, lecture_id, '/audio/' || lecture_id AS wav, "start", "end", ref, CASE WHEN conv_id % 3 = 0 THEN 'dev' ELSE 'test' END AS split,
    row_number() OVER (PARTITION BY lecture_id ORDER BY utt_id) AS rn FROM utts WHERE {hash_sql('utt_id', "'title'")} % 40 <> 0),
pk(lecture_id, rn, utt_id, ref, "start", "end", open_id, open_start, closed) AS (
  SELECT lecture_id, rn, utt_id, ref, "start", "end", rn, "start", "end" - "start" >= 25 FROM seg_ WHERE rn = 1
  UNION ALL
  SELECT s.lecture_id, s.rn, s.utt_id, s.ref, s."start", s."end",
    CASE WHEN p.closed OR abs(s."start" - p."end") > 1e-6 THEN s.rn ELSE p.open_id END,
    CASE WHEN p.closed OR abs(s."start" - p."end") > 1e-6 THEN s."start" ELSE p.open_start END,
    s."end" - CASE WHEN p.closed OR abs(s."start" - p."end") > 1e-6 THEN s."start" ELSE p.open_start END >= 25
  FROM pk p JOIN seg_ s ON s.lecture_id = p.lecture_id AND s.rn = p.rn + 1),
packs AS (SELECT lecture_id, open_id, min_by(utt_id, rn) || '+' || count(*) AS utt_id, min_by("start", rn) AS "start", max_by("end", rn) AS "end",
    string_agg(ref, ' ' ORDER BY rn) AS ref, count(*)::INT AS n_segments FROM pk GROUP BY lecture_id, open_id)"""


def pack_input(spark, sf):
    return utterances(spark, sf).select(
        "utt_id", "lecture_id", F.concat(F.lit("/audio/"), "lecture_id").alias("wav"), "start", "end", "ref",
        F.when(F.col("conv_id") % 3 == 0, "dev").otherwise("test").alias("split"),
        (seeded_hash(F.col("utt_id"), "title") % 40 == 0).alias("title_source"))


@query("win2_pack_segments", with_(PACK, body="""SELECT p.utt_id, p.lecture_id, '/audio/' || p.lecture_id AS wav, p."start", p."end", round_even(p."end" - p."start", 2) AS dur, p.ref, n_segments,
  CASE WHEN lecture_id::BIGINT % 3 = 0 THEN 'devcat' ELSE 'testcat' END AS split FROM packs p WHERE p."end" - p."start" BETWEEN 18 AND 28""", recursive=True))
def win2(spark, sf):
    return P.pack_segments(pack_input(spark, sf), utt_block())


# --- courses -------------------------------------------------------------------------
RULES = [("^src1[0-4]", "alpha"), ("7$", "beta"), ("^src1", "gamma")]
COURSES = """lec_ AS (SELECT doc_id, source || '_' || doc_id AS lecture_id FROM documents),
map_ AS (SELECT source || '_' || doc_id AS lecture_id, 'q' || toxic AS course_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
courses_ AS (SELECT lecture_id, coalesce(m.course_id, CASE WHEN regexp_matches(lecture_id, '^src1[0-4]') THEN 'alpha' WHEN regexp_matches(lecture_id, '7$') THEN 'beta'
    WHEN regexp_matches(lecture_id, '^src1') THEN 'gamma' ELSE lower(regexp_split_to_array(lecture_id, '[_\\-.]')[1]) END) AS course_id, m.course_id IS NOT NULL AS explicit, doc_id
  FROM lec_ LEFT JOIN map_ m USING (lecture_id))"""


def lecture_map(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("lecture_id"))
    good = table(spark, sf, "labels").filter("quality = 1")
    return d, d.join(good, "doc_id").select("lecture_id", F.concat(F.lit("q"), F.col("toxic").cast("string")).alias("course_id"))


@query("jn4_course_of", with_(COURSES, body="SELECT doc_id, lecture_id, course_id, explicit FROM courses_"))
def jn4(spark, sf):
    return M.course_of(*lecture_map(spark, sf), RULES)


@query("jn5_mismatched_pairs", """WITH c AS (SELECT DISTINCT c_name AS course_id FROM customer),
r AS (SELECT course_id, row_number() OVER (ORDER BY course_id) - 1 AS place, count(*) OVER () AS n FROM c),
k AS (SELECT *, list_reduce(list_transform(string_split(md5(course_id), ''), lambda h: ('0x' || h)::BIGINT), lambda a, d: (a * 16 + d) % (n - 1), 0::BIGINT) AS k FROM r)
SELECT k.course_id, o.course_id AS other_id FROM k JOIN r o ON o.place = CASE WHEN k.k < k.place THEN k.k ELSE k.k + 1 END""")
def jn5(spark, sf):
    return M.mismatched_pairs(table(spark, sf, "customer").select(F.col("c_name").alias("course_id")), F.substring("course_id", 1, 14))


NEED_HAVE = "need AS (SELECT DISTINCT 'c' || o_custkey AS course_id FROM orders), have AS (SELECT 'c' || c_custkey AS course_id FROM customer WHERE c_acctbal > 0)"


def need_have(spark, sf):
    c = lambda k: F.concat(F.lit("c"), F.col(k).cast("string")).alias("course_id")
    return table(spark, sf, "orders").select(c("o_custkey")), table(spark, sf, "customer").filter("c_acctbal > 0").select(c("c_custkey"))


@query("jn9_course_gaps", with_(NEED_HAVE, body="""SELECT course_id, 'missing' AS status FROM need WHERE course_id NOT IN (FROM have)
  UNION ALL SELECT course_id, 'unused' FROM have WHERE course_id NOT IN (FROM need)"""))
def jn9(spark, sf):
    return M.course_gaps(*need_have(spark, sf))


@query("set2_course_difference", with_(NEED_HAVE, body="SELECT course_id FROM need EXCEPT SELECT course_id FROM have"))
def set2(spark, sf):
    need, have = need_have(spark, sf)
    return M.set_difference(need.distinct(), have)


VALID = f"""have_ AS (SELECT DISTINCT source AS course_id FROM documents WHERE n_chars > 10000 UNION SELECT 'q0'),
valid_ AS (SELECT lecture_id, course_id, sum(({hash_sql('doc_id')} % 3 = 0)::BIGINT)::BIGINT AS eval_utts, bool_or(explicit) AS mapped,
  course_id IN (SELECT course_id FROM have_) AS has_syllabus FROM courses_ GROUP BY lecture_id, course_id)"""


def validated(spark, sf):
    d, mapping = lecture_map(spark, sf)
    rows = d.select("lecture_id", (seeded_hash(F.col("doc_id")) % 3 == 0).alias("in_eval"))
    big = table(spark, sf, "documents").filter("n_chars > 10000").select(F.col("source").alias("course_id"))
    have = big.union(mapping.filter("course_id = 'q0'").select("course_id"))
    return M.validate_mapping(rows, mapping, RULES, have), have


@query("jn10_validate_mapping", with_(COURSES, VALID, body="SELECT lecture_id, course_id, eval_utts, mapped, has_syllabus FROM valid_"))
def jn10(spark, sf):
    return validated(spark, sf)[0]


@query("jn10_course_totals", with_(COURSES, VALID, body="SELECT course_id, sum(eval_utts)::BIGINT AS eval_utts, count(*) AS n_lectures FROM valid_ GROUP BY course_id"))
def jn10_totals(spark, sf):
    return M.course_totals(validated(spark, sf)[0])


@query("jn10_mapping_complete", with_(COURSES, VALID, body="""SELECT count(*) AS n_lectures, count(DISTINCT course_id) AS n_courses, (SELECT count(*) FROM have_) AS n_syllabi,
  bool_and(mapped AND has_syllabus) AND (SELECT count(*) FROM have_) >= 2 AS complete FROM valid_"""))
def jn10_complete(spark, sf):
    return M.mapping_complete(*validated(spark, sf))


@query("jn18_resolve_paths", """WITH w AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a/' || c_name || '.wav' WHEN 1 THEN '/data/b/' || c_name || '.wav' ELSE 'old/' || c_name || '.wav' END AS path FROM customer),
l AS (SELECT '/data/a/' || c_name || '.wav' AS path FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT '/data/b/' || c_name || '.wav' FROM customer WHERE c_custkey % 5 <> 0),
f AS (SELECT *, CASE WHEN starts_with(path, '/') THEN path ELSE '/data/' || path END AS full_, string_split(path, '/')[-1] AS base FROM w),
b AS (SELECT string_split(path, '/')[-1] AS base, min(path) AS hit FROM l GROUP BY 1)
SELECT c_custkey, f.path, CASE WHEN l.path IS NOT NULL THEN full_ ELSE hit END AS resolved, CASE WHEN l.path IS NULL AND hit IS NULL THEN base END AS missing
FROM f LEFT JOIN l ON full_ = l.path LEFT JOIN b USING (base)""")
def jn18(spark, sf):
    c = table(spark, sf, "customer")
    wav = lambda d: F.concat(F.lit(d), "c_name", F.lit(".wav"))
    k = F.col("c_custkey")
    wanted = c.select("c_custkey", F.when(k % 3 == 0, wav("a/")).when(k % 3 == 1, wav("/data/b/")).otherwise(wav("old/")).alias("path"))
    listing = c.filter(k % 7 != 0).select(wav("/data/a/").alias("path")).union(c.filter(k % 5 != 0).select(wav("/data/b/").alias("path")))
    return K.resolve_paths(wanted, listing, "/data")
