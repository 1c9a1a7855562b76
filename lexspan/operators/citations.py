"""Retrieval contexts for questions: vector search, merging, sources, citations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import is_blank, mmss, strip
from lexspan.functions.vectors import Balls, unit_rows
from lexspan.operators.ordered import first_n

# fixed values
TOP_K, SECONDARY_K, KEEP, MIN_CITED = 12, 6, 14, 3
HISTORY_TURNS, RENDERED_TURNS = 8, 6
SCORE_DIGITS = 9
NOTHING_FOUND = ("I couldn't find anything about that in your lectures for this subject. "
                 "Either it hasn't been covered yet, or the recording is still processing.")
# end of fixed values


# A subject with many questions or items is cut into cells of about this many of each; balls keep the products of a cell few.
CELL_QUESTIONS, CELL_ITEMS = 1_000, 32_000


def _best_in_cells(questions: DataFrame, items: DataFrame, ks: dict[bool, int] | None, k: int) -> DataFrame:
    """Candidates (question_id, id, score, side) for each question's best items inside its scope.

    Questions and items of a subject are dealt into blocks by their ids, and every pair of blocks is a cell. In it items lie
    in balls and a question meets only balls whose bound reaches its k-th score so far; only each question's best rows leave, so neither a
    large subject nor its vectors pass through one task. ``ks``: how many of the items whose kind is the wanted one (True) and of
    the others (False) a question may need; otherwise ``k`` of all. An item without a vector, or with one of another size,
    has a NULL score and comes last.
    """
    n_q = questions.groupBy("subject_id").agg(F.ceil(F.count(F.lit(1)) / CELL_QUESTIONS).alias("q_cells"))
    n_i = items.groupBy("subject_id").agg(F.ceil(F.count(F.lit(1)) / CELL_ITEMS).alias("i_cells"))
    cells = n_q.join(n_i, "subject_id")
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    wants = F.col("wants_notes") if ks else F.lit(True)
    is_note = F.col("kind") == "note" if ks else F.lit(True)
    q = questions.join(cells, "subject_id").select("subject_id", block("question_id", "q_cells").alias("qb"), copies("i_cells").alias("ib"),
                                                   "question_id", F.col("lecture_id").alias("only_lecture"), "vector", wants.alias("wants"))
    i = items.join(cells, "subject_id").select("subject_id", copies("q_cells").alias("qb"), block("id", "i_cells").alias("ib"), "id", "lecture_id", "embedding", is_note.alias("is_note"))

    def search(qs: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        its = its.iloc[np.argsort(its["id"].to_numpy(), kind="stable")]
        ids, of_note = its["id"].to_numpy(), its["is_note"].to_numpy(dtype=bool)
        sizes = np.array([-1 if v is None else len(v) for v in its["embedding"]], int)
        asked_size = np.array([-1 if v is None else len(v) for v in qs["vector"]], int)
        names, wanted = qs["question_id"].to_numpy(), qs["wants"].to_numpy(dtype=bool)
        parts = []

        def add(who: np.ndarray, score: np.ndarray, at: np.ndarray, rest: np.ndarray, side: bool, keep: int) -> None:
            """The best rows of these questions; items without a score follow by id."""
            found = np.isfinite(score)
            spare = np.maximum(0, keep - found.sum(axis=1))
            if len(rest) and spare.any():
                more = rest[: int(spare.max())]
                fill = np.arange(len(more)) < spare[:, None]
                at, score = np.concatenate([at, np.broadcast_to(more, (len(at), len(more)))], axis=1), np.concatenate([score, np.full(fill.shape, np.nan)], axis=1)
                found = np.concatenate([found, fill], axis=1)
            row, column = np.nonzero(found)
            parts.append(pd.DataFrame({"question_id": names[who][row], "id": ids[at[row, column]], "score": score[row, column], "primary": side}))

        only = qs["only_lecture"].to_numpy()
        free = pd.isna(only)
        scopes = [(np.ones(len(its), bool), free)] + [((its["lecture_id"] == x).to_numpy(), only == x) for x in pd.unique(only[~free])]
        for size in np.unique(asked_size):
            units = np.full((len(its), max(size, 1)), np.nan)
            if size > 0 and (sizes == size).any():
                units[sizes == size] = unit_rows(its["embedding"][sizes == size])
            scored = ~np.isnan(units[:, 0])
            for inside, mine in scopes:
                for kind in (True, False):
                    members = np.flatnonzero(inside & (of_note == kind))
                    if not len(members):
                        continue
                    balls = Balls(units[members[scored[members]]])
                    for want in (True, False):
                        keep = (ks or {True: k, False: 0})[want == kind]
                        who = np.flatnonzero(mine & (asked_size == size) & (wanted == want))
                        if not len(who) or not keep:
                            continue
                        asks = unit_rows(qs["vector"].iloc[who]) if size > 0 else np.full((len(who), 1), np.nan)
                        none = np.isnan(asks[:, 0])
                        score, at = balls.best(asks[~none], keep)
                        place = np.append(members[scored[members]], -1)
                        add(who[~none], score, place[at], members[~scored[members]], want == kind, keep)
                        add(who[none], np.zeros((none.sum(), 0)), np.zeros((none.sum(), 0), int), members, want == kind, keep)
        if not parts:
            return pd.DataFrame(columns=["question_id", "id", "score", "primary"])
        out = pd.concat(parts)
        return out.assign(score=out["score"].astype(object).where(out["score"].notna(), None))

    types = {f.name: f.dataType.simpleString() for df in (questions, items) for f in df.schema}
    keys = ["subject_id", "qb", "ib"]
    found = q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(search, f"question_id {types['question_id']}, id {types['id']}, score double, primary boolean")
    return found.withColumn("score", F.bround("score", SCORE_DIGITS))


def _with_items(hits: DataFrame, questions: DataFrame, items: DataFrame) -> DataFrame:
    """Hits, at most k for each question, with what else their items carry."""
    return hits.join(items.drop("embedding"), "id").join(questions.select("question_id", "subject_id"), ["question_id", "subject_id"])


def vector_top_k(questions: DataFrame, items: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` most similar items of every question inside its scope.

    ``questions``: question_id, subject_id, lecture_id (NULL for the whole
    subject), vector. ``items``: id, subject_id, lecture_id, embedding, and
    whatever else should be returned. Ids are unique.
    """
    best = first_n(_best_in_cells(questions, items, None, k).drop("primary"), ["question_id"], [F.desc_nulls_last("score"), F.col("id")], k)
    return _with_items(best, questions, items)


def merge_sources(primary: DataFrame, secondary: DataFrame, keep: int = KEEP) -> DataFrame:
    """Both result lists by score (missing is 0), primary first on ties."""
    both = primary.withColumn("source", F.lit(0)).unionByName(secondary.withColumn("source", F.lit(1)))
    return first_n(both.withColumnRenamed("rank", "source_rank"), ["question_id"],
                   [F.desc(F.coalesce("score", F.lit(0.0))), F.col("source"), F.col("source_rank")], keep)


def gather(questions: DataFrame, items: DataFrame, top_k: int = TOP_K, secondary_k: int = SECONDARY_K,
           keep: int = KEEP) -> DataFrame:
    """Search notes and spans for every question and merge.

    Notes lead when the question wants them, spans otherwise. ``items`` carries
    kind ('note' or 'span'). Both collections are scored in one pass; a hit of
    the secondary collection survives only within its own smaller top.
    """
    found = _best_in_cells(questions, items, {True: top_k, False: secondary_k}, 0)
    scored = found.select("question_id", "id", "score", F.when(F.col("primary"), 0).otherwise(1).alias("source"))
    per_side = first_n(scored, ["question_id", "source"], [F.desc_nulls_last("score"), F.col("id")],
                       max(top_k, secondary_k), "source_rank")
    inside = F.col("source_rank") <= F.when(F.col("source") == 0, top_k).otherwise(secondary_k)
    kept = first_n(per_side.filter(inside), ["question_id"],
                   [F.desc(F.coalesce("score", F.lit(0.0))), F.col("source"), F.col("source_rank")], keep)
    return _with_items(kept, questions, items)


#: Letters of a gram by which hints look for titles.
HINT_GRAM = 3


def _title_grams(title: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(title), F.lit(1)))
    sizes = F.array(*[F.lit(n) for n in range(1, HINT_GRAM + 1)])
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(sizes, lambda n: F.substring(title, i, n)))))


def title_postings(lectures: DataFrame) -> DataFrame:
    """(subject_id, low, created_order, lecture_id, gram): equal titles of a subject are one, the first of them.

    Laid out by gram, for the index and for the hints that meet it: the grams of a small table are many rows,
    so whatever joins them says "merge". Spark's estimate from the table's size would send them all through the driver.
    """
    titles = lectures.groupBy("subject_id", F.lower("title").alias("low")).agg(
        F.min_by("lecture_id", "created_order").alias("lecture_id"), F.min("created_order").alias("created_order"))
    return titles.select("*", F.explode(_title_grams(F.col("low"))).alias("gram")).repartition("subject_id", "gram")


def title_index(postings: DataFrame) -> DataFrame:
    """(subject_id, gram, n, lecture_id): how many titles have a gram, and the first of them."""
    return postings.groupBy("subject_id", "gram").agg(F.count(F.lit(1)).alias("n"), F.min_by("lecture_id", "created_order").alias("lecture_id"))


def rarest_grams(hinted: DataFrame, index: DataFrame) -> DataFrame:
    """(subject_id, hint, gram, n): of each hint the gram that the fewest titles have; none where no title has some gram of it."""
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("hint") - HINT_GRAM + 1), lambda i: F.substring(F.col("hint"), i, F.lit(HINT_GRAM))))
    asked = hinted.select("subject_id", "hint", F.size(own).alias("needs"), F.explode(own).alias("gram")).join(index.select("subject_id", "gram", "n").hint("merge"), ["subject_id", "gram"])
    by_hint = asked.groupBy("subject_id", "hint", "needs").agg(F.count(F.lit(1)).alias("has"), F.min(F.struct("n", "gram")).alias("best"))
    return by_hint.filter("has = needs").select("subject_id", "hint", "best.gram", "best.n")


def resolve_hints(questions: DataFrame, lectures: DataFrame) -> DataFrame:
    """The first lecture (by created order) of the subject whose lower-cased title
    contains the trimmed hint; NULL for an empty hint or no match.

    An index of title grams counts the titles of each (subject, gram) and knows the first
    of them, which already answers a hint of up to three letters. A longer hint asks with
    the rarest of its grams only; one that has a gram no title has asks for nothing.
    ``lectures``: lecture_id, subject_id, title, created_order.
    """
    hint = strip(F.lower(F.coalesce("lecture_hint", F.lit(""))))
    hinted = questions.select("subject_id", hint.alias("hint")).filter(F.col("hint") != "").distinct()
    postings = title_postings(lectures)
    index = title_index(postings)
    short = hinted.filter(F.length("hint") <= HINT_GRAM).join(index.select("subject_id", F.col("gram").alias("hint"), "lecture_id").hint("merge"), ["subject_id", "hint"])
    met = rarest_grams(hinted.filter(F.length("hint") > HINT_GRAM), index).join(postings.hint("merge"), ["subject_id", "gram"])
    found = met.filter(F.contains("low", "hint")).groupBy("subject_id", "hint").agg(F.min_by("lecture_id", "created_order").alias("lecture_id"))
    first = short.unionByName(found)
    return questions.withColumn("hint", hint).join(first, ["subject_id", "hint"], "left").select(*questions.columns, "lecture_id")


def route_record(raw: Column, question: Column) -> Column:
    """Routing JSON with defaults: type "lookup", query = question, hint trimmed."""
    r = F.from_json(raw, "query_type string, search_query string, lecture_hint string, wants_notes boolean")
    return F.struct(
        F.coalesce(r["query_type"], F.lit("lookup")).alias("query_type"),
        F.coalesce(F.nullif(r["search_query"], F.lit("")), question).alias("search_query"),
        strip(F.coalesce(r["lecture_hint"], F.lit(""))).alias("lecture_hint"),
        F.coalesce(r["wants_notes"], F.lit(False)).alias("wants_notes"),
    )


def citation(n: Column) -> Column:
    start = F.coalesce("start_s", F.lit(0.0)).cast("double")
    return F.struct(
        n.cast("int").alias("n"), F.col("kind"), F.col("lecture_id"), F.col("lecture_title"), start.alias("start_s"),
        F.coalesce("end_s", F.lit(0.0)).cast("double").alias("end_s"), mmss(start).alias("timestamp"), F.col("note_id"),
    )


def render_sources(hits: DataFrame) -> DataFrame:
    """Source text and citations of each question from its ranked hits (at most 14)."""
    label = F.when(F.col("kind") == "note", "notes").otherwise("transcript")
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("lecture_title", F.lit("Untitled")), F.lit(" — "),
        label, F.lit(" @ "), mmss(F.coalesce("start_s", F.lit(0.0))), F.lit("\n"), F.col("text"),
    )
    return (
        hits.groupBy("question_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b"), citation(F.col("rank")).alias("c")))).alias("m"))
        .select(
            "question_id",
            F.array_join(F.transform("m", lambda s: s["b"]), "\n\n---\n\n").alias("sources"),
            F.transform("m", lambda s: s["c"]).alias("citations"),
        )
    )


def question_sources(questions: DataFrame, hits: DataFrame, fixed: tuple[str, ...] = ("coverage", "smalltalk")) -> DataFrame:
    """Every question with its sources, citations and, where no model is asked, its answer.

    ``questions``: question_id, query_type, fixed_answer (for the types that are answered from facts). A question of
    another type without hits gets the fixed sentence; with hits, its answer is NULL until a model writes it.
    """
    asks = ~F.col("query_type").isin(*fixed)
    found = render_sources(hits.join(questions.filter(asks).select("question_id"), "question_id", "left_semi"))
    none = F.array().cast(found.schema["citations"].dataType)
    return questions.join(found, "question_id", "left").select(
        "question_id", "query_type", "sources", F.coalesce("citations", none).alias("citations"),
        F.when(~asks, F.col("fixed_answer")).when(F.col("sources").isNull(), F.lit(NOTHING_FOUND)).alias("answer"),
    )


def used_citations(citations: Column, answer: Column) -> Column:
    """Citations whose ``[n]`` occurs in the answer, the first three if none does."""
    used = F.filter(citations, lambda c: F.contains(answer, F.concat(F.lit("["), c["n"].cast("string"), F.lit("]"))))
    return F.when(F.size(used) > 0, used).otherwise(F.slice(citations, 1, MIN_CITED))


def recent_history(messages: DataFrame, fetched: int = HISTORY_TURNS, rendered: int = RENDERED_TURNS) -> DataFrame:
    """The last messages of each session, and the last few rendered oldest first.

    ``messages``: session_id, seq, role, content."""
    last = first_n(messages, ["session_id"], [F.desc("seq")], fetched)
    line = F.concat("role", F.lit(": "), "content", F.lit("\n"))
    return last.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_fetched"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= rendered, F.struct("seq", line.alias("l"))))),
                        lambda s: s["l"]), "").alias("convo"),
    )


def history_or_none(convo: Column) -> Column:
    return F.coalesce(F.nullif(convo, F.lit("")), F.lit("(none)"))


def note_documents(notes: DataFrame, lectures: DataFrame) -> DataFrame:
    """Index documents of notes: ``topic``, blank line, ``markdown``; blank skipped."""
    body = strip(F.concat(F.coalesce("topic", F.lit("")), F.lit("\n\n"), F.coalesce("markdown", F.lit(""))))
    return (
        notes.join(lectures.select("lecture_id", "subject_id", "lecture_title"), "lecture_id")
        .select(
            F.concat(F.lit("note:"), F.col("note_id").cast("string")).alias("id"), body.alias("document"), F.lit("note").alias("kind"),
            "subject_id", "lecture_id", "lecture_title", "note_id", "topic", F.coalesce("unit_id", F.lit("")).alias("unit_id"),
            F.coalesce("start_s", F.lit(0.0)).alias("start_s"), F.coalesce("end_s", F.lit(0.0)).alias("end_s"),
        )
        .filter(~is_blank(F.col("document")))
    )
