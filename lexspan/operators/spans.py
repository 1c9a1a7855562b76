"""Spans over a recording: packing, overlapping chunks, quiet cuts, checks.

Packing and cutting are greedy walks, so each step depends on the one before.
A long recording is therefore walked in blocks: every block first works out, in
parallel, where it would leave off for each state it could be entered in; those
small tables are chained per recording; then all blocks are walked in parallel
from their true entry state. Short recordings are one block and skip the chain.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import strip
from lexspan.operators.ordered import ordered

# fixed values
TARGET_DUR, MIN_CONCAT_DUR, MAX_DUR = 25.0, 18.0, 28.0
ADJACENT = 1e-6
WINDOW, STRIDE = 3, 2
SPAN_TARGET_S, SPAN_MIN_S, SPAN_MAX_S = 25.0, 8.0, 28.0
FRAME_S, ENERGY_FLOOR = 0.03, 1e-12


# --- packing adjacent segments ------------------------------------------------
def _pack_exits(pdf: pd.DataFrame, target: float) -> dict:
    """What a block does to the open pack it is entered with."""
    start, end, pos = pdf["start"].tolist(), pdf["end"].tolist(), pdf["pos"].tolist()
    n = len(pos)
    # leave[i]: pack left open at the block end when a new pack starts at row i
    leave: list = [None] * (n + 1)
    for i in range(n - 1, -1, -1):
        k = i
        while True:
            if end[k] - start[i] >= target or (k + 1 < n and abs(start[k + 1] - end[k]) > ADJACENT):
                leave[i] = leave[k + 1]
                break
            if k + 1 == n:
                leave[i] = (pos[i], start[i])
                break
            k += 1
    # rows at which a pack opened earlier could close: up to the first gap, or to
    # where even a pack opened at this block's first row would be long enough
    ends, exits, gap = [], [leave[0]], False
    for k in range(n):
        ends.append(end[k])
        exits.append(leave[k + 1])
        gap = k + 1 < n and abs(start[k + 1] - end[k]) > ADJACENT
        if gap or end[k] - start[0] >= target:
            break
    none = float("nan")
    return dict(
        first_start=start[0], last_end=end[-1], gap=gap, ends=ends,
        exit_pos=[-1 if x is None else x[0] for x in exits],
        exit_start=[none if x is None else x[1] for x in exits],
    )


def _chain_packs(pdf: pd.DataFrame, target: float) -> list[tuple]:
    """Open pack each block is entered with, walking the block tables in order."""
    open_pos, open_start, prev_end, out = -1, float("nan"), float("nan"), []
    for b in pdf.sort_values("blk").itertuples():
        if open_pos >= 0 and abs(b.first_start - prev_end) > ADJACENT:
            open_pos = -1
        out.append((b.blk, open_pos, open_start, prev_end))
        if open_pos < 0:
            open_pos, open_start = int(b.exit_pos[0]), b.exit_start[0]
        else:
            closes = [k for k, e in enumerate(b.ends) if e - open_start >= target]
            if not closes and b.gap:
                closes = [len(b.ends) - 1]
            if closes:
                open_pos, open_start = int(b.exit_pos[closes[0] + 1]), b.exit_start[closes[0] + 1]
        prev_end = b.last_end
    return out


def _assign_packs(pdf: pd.DataFrame, target: float) -> list[int]:
    first = pdf.iloc[0]
    open_pos = -1 if pd.isna(first["open_pos"]) else int(first["open_pos"])
    open_start, prev_end = first["open_start"], first["prev_end"]
    out = []
    for pos, start, end in zip(pdf["pos"].tolist(), pdf["start"].tolist(), pdf["end"].tolist()):
        if open_pos >= 0 and abs(start - prev_end) > ADJACENT:
            open_pos = -1
        if open_pos < 0:
            open_pos, open_start = pos, start
        out.append(open_pos)
        prev_end = end
        if end - open_start >= target:
            open_pos = -1
    return out


def pack_segments(
    segments: DataFrame,
    utt_block: Column,
    target: float = TARGET_DUR,
    min_dur: float = MIN_CONCAT_DUR,
    max_dur: float = MAX_DUR,
    block_rows: int = 65_536,
) -> DataFrame:
    """Merge strictly adjacent segments of a lecture, in utt_id order, into spans.

    A pack closes at a gap or once it reaches ``target`` seconds; a closed pack
    is kept only when ``min_dur <= dur <= max_dur`` and dropped whole otherwise.
    ``utt_block`` is a monotone coarsening of utt_id (see ``ordered``).
    Input columns: utt_id, lecture_id, wav, start, end, ref, split, title_source.
    """
    target = min(target, max_dur)
    rows = segments.filter(~F.coalesce(F.col("title_source"), F.lit(False))).select(
        "utt_id", "lecture_id", "wav", "start", "end", "ref", "split"
    )
    rows = ordered(rows, ["lecture_id"], ["utt_id"], utt_block, position="pos", total="n_rows")
    rows = rows.withColumn("blk", F.floor(F.col("pos") / block_rows))

    def summarise(key, pdf):
        return pd.DataFrame([dict(lecture_id=key[0], blk=key[1], **_pack_exits(pdf.sort_values("pos"), target))])

    def chain(key, pdf):
        return pd.DataFrame([(key[0], *t) for t in _chain_packs(pdf, target)],
                            columns=["lecture_id", "blk", "open_pos", "open_start", "prev_end"])

    tables = rows.filter(F.col("n_rows") > block_rows).select("lecture_id", "blk", "pos", "start", "end").groupBy(
        "lecture_id", "blk"
    ).applyInPandas(
        summarise,
        "lecture_id string, blk long, first_start double, last_end double, gap boolean, ends array<double>, "
        "exit_pos array<long>, exit_start array<double>",
    )
    entry = tables.groupBy("lecture_id").applyInPandas(
        chain, "lecture_id string, blk long, open_pos long, open_start double, prev_end double"
    )

    def assign(pdf):
        pdf = pdf.sort_values("pos")
        return pdf[["lecture_id", "utt_id", "wav", "start", "end", "ref", "split", "pos"]].assign(
            pack=_assign_packs(pdf, target)
        )

    packed = rows.join(entry, ["lecture_id", "blk"], "left").groupBy("lecture_id", "blk").applyInPandas(
        assign,
        "lecture_id string, utt_id string, wav string, start double, end double, ref string, split string, "
        "pos long, pack long",
    )
    first = lambda c: F.min_by(c, "pos")
    spans = packed.groupBy("lecture_id", "pack").agg(
        F.concat(first("utt_id"), F.lit("+"), F.count(F.lit(1)).cast("string")).alias("utt_id"),
        first("wav").alias("wav"), first("start").alias("start"), F.max_by("end", "pos").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda s: s["ref"]), " ").alias("ref"),
        F.count(F.lit(1)).cast("int").alias("n_segments"), first("split").alias("split"),
    )
    dur = F.col("end") - F.col("start")
    return spans.filter(dur.between(min_dur, max_dur)).select(
        "utt_id", "lecture_id", "wav", "start", "end", F.bround(dur, 2).alias("dur"), "ref", "n_segments",
        F.when(F.col("split") == "dev", "devcat").otherwise("testcat").alias("split"),
    )


# --- overlapping chunks ---------------------------------------------------------
def overlapping_chunks(spans: DataFrame, lectures: DataFrame | None = None, index_block: int = 4096) -> DataFrame:
    """Windows of 3 spans every 2 by position; blank windows are skipped.

    Input: lecture_id, index, start_s, end_s, text (other columns are ignored). With ``lectures``
    (lecture_id, subject_id, lecture_title) a chunk also has its kind, subject and lecture title, as
    a search within a subject needs.
    A span belongs to the window starting at its own even position and, when the
    position is even, to the one before, so windows form by grouping.
    """
    rows = ordered(
        spans.select("lecture_id", "index", "start_s", "end_s", "text"),
        ["lecture_id"], ["index"], F.floor(F.col("index") / index_block), position="p", total="n",
    )
    even = F.floor(F.col("p") / STRIDE) * STRIDE
    starts = F.filter(
        F.array(even, F.when((F.col("p") % STRIDE == 0) & (F.col("p") >= STRIDE), F.col("p") - STRIDE)),
        lambda s: s.isNotNull() & ((s == 0) | (s + 1 < F.col("n"))),
    )
    member = F.array_sort(F.collect_list(F.struct("p", "index", "text")))
    chunks = (
        rows.withColumn("w", F.explode(starts))
        .groupBy("lecture_id", "w")
        .agg(
            member.alias("m"),
            F.min_by("start_s", "p").alias("start_s"),
            F.max_by("end_s", "p").alias("end_s"),
        )
        .select(
            F.concat(F.col("lecture_id").cast("string"), F.lit(":w"), F.col("w").cast("string")).alias("id"),
            "lecture_id",
            strip(F.array_join(F.transform("m", lambda s: s["text"]), " ")).alias("document"),
            "start_s", "end_s",
            F.array_join(F.transform("m", lambda s: s["index"].cast("string")), ",").alias("span_indices"),
        )
        .filter(F.col("document") != "")
    )
    if lectures is None:
        return chunks
    of = lectures.select("lecture_id", "subject_id", "lecture_title")
    return chunks.join(of, "lecture_id", "left").withColumn("kind", F.lit("span"))


def span_checks(spans: DataFrame, durations: DataFrame, index_block: int = 4096,
                min_s: float = SPAN_MIN_S, max_s: float = SPAN_MAX_S) -> DataFrame:
    """Contiguity, full coverage and length bounds of every recording's spans."""
    rows = ordered(
        spans.select("lecture_id", "index", "start_s", "end_s"), ["lecture_id"], ["index"],
        F.floor(F.col("index") / index_block), position="p", total="n",
        previous={"prev_end": F.col("end_s")},
    ).join(durations, "lecture_id", "left")
    dur, last = F.col("end_s") - F.col("start_s"), F.col("p") == F.col("n") - 1
    near = lambda a, b: F.abs(a - b) <= ADJACENT
    return rows.groupBy("lecture_id").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.bool_and((F.col("p") == 0) | near(F.col("start_s"), F.col("prev_end"))).alias("contiguous"),
        F.bool_and(~last | near(F.col("end_s"), F.col("duration_s"))).alias("ends_at_duration"),
        F.bool_and(dur <= max_s + ADJACENT).alias("all_within_max"),
        F.bool_and(last | (dur >= min_s)).alias("all_but_last_reach_min"),
    )


# --- frame energies and quiet cuts ---------------------------------------------
def frame_energy(signal: DataFrame, frame_len: int) -> DataFrame:
    """Root-mean-square per frame of a (rec, pos, x) signal.

    A trailing partial frame is dropped; a recording without one full frame gets
    a single frame of energy zero.
    """
    frames = signal.groupBy("rec", F.floor(F.col("pos") / frame_len).alias("frame")).agg(
        F.count(F.lit(1)).alias("k"), F.avg(F.col("x").cast("double") * F.col("x")).alias("ms")
    )
    full = frames.filter(F.col("k") == frame_len)
    return full.select("rec", "frame", F.sqrt(F.col("ms") + ENERGY_FLOOR).alias("rms")).unionByName(
        frames.filter((F.col("frame") == 0) & (F.col("k") < frame_len)).select(
            "rec", F.lit(0).cast("long").alias("frame"), F.lit(0.0).alias("rms")
        )
    )


def _cut(cursor: float, rms: np.ndarray, first: int, n_frames: int, fps: float, p: tuple) -> float:
    """Next boundary after ``cursor``; ``rms`` holds frames from ``first`` on."""
    target, low, high = p
    lo_f = int((cursor + max(low, target - 5.0)) * fps)
    hi_f = int((cursor + min(high, target + 3.0)) * fps)
    lo_f = max(0, min(lo_f, n_frames - 1))
    hi_f = max(lo_f + 1, min(hi_f, n_frames))
    at = lo_f + int(np.argmin(rms[lo_f - first : hi_f - first]))
    cut = min(at / fps, cursor + high)
    return cursor + target if cut - cursor < low else cut


def _grid_safe(fps: float, p: tuple) -> bool:
    """True when every cut falls on a frame, so block entry states are frames."""
    target, low, high = p
    return max(low, target - 5.0) - 2 / fps >= low and min(high, target + 3.0) <= high


def plan_spans(
    frames: DataFrame,
    lengths: DataFrame,
    frames_per_s: float,
    target_s: float = SPAN_TARGET_S,
    min_s: float = SPAN_MIN_S,
    max_s: float = SPAN_MAX_S,
    block_frames: int = 1_000_000,
) -> DataFrame:
    """Cut every recording at its quietest frame near ``target_s``.

    ``frames`` is (rec, frame, rms), ``lengths`` is (rec, total_s). The walk is
    greedy, left to right; a remainder of at most ``max_s`` is the last span.
    Returns (rec, index, start_s, end_s).

    Long recordings are walked in blocks, tabulated by the frame at which a block is entered. Settings whose cuts may
    leave the frame grid (a minimum within five seconds of the target, say) have no such table: then a
    recording is walked as one block.
    """
    fps, p = float(frames_per_s), (target_s, min_s, max_s)
    reach = math.ceil((min(max_s, target_s + 3.0)) * fps) + 2  # frames a cut can look ahead
    if not 0 < target_s or not 0 <= min_s <= max_s or max_s <= 0:
        raise ValueError("target_s and max_s must be positive, min_s between 0 and max_s")
    block_frames = max(block_frames, 2 * reach) if _grid_safe(fps, p) else 1 << 52

    n = frames.groupBy("rec").agg((F.max("frame") + 1).alias("n_frames"))
    # a recording without samples still gets its one (empty) span
    known = lengths.join(n, "rec", "left")
    bare = known.filter("n_frames IS NULL").select("rec", "total_s", F.lit(1).cast("long").alias("n_frames"), F.lit(0).cast("long").alias("frame"), F.lit(0.0).alias("rms"))
    # an inner join: the frames of one huge recording can be split over tasks
    rows = frames.join(known.filter("n_frames IS NOT NULL"), "rec").select(
        "rec", "total_s", "n_frames", F.col("frame").cast("long").alias("frame"), F.coalesce("rms", F.lit(0.0)).alias("rms")
    ).union(bare)
    own = F.floor(F.col("frame") / block_frames)
    borrowed = F.when((own > 0) & (F.col("frame") % block_frames < 2 * reach), own - 1)
    blocks = rows.withColumn("blk", F.explode(F.filter(F.array(own, borrowed), lambda b: b.isNotNull())))

    def walk(pdf, blk, cursor):
        """Spans from ``cursor`` on, until one leaves the block."""
        total, n_frames = float(pdf["total_s"].iloc[0]), int(pdf["n_frames"].iloc[0])
        rms, first = pdf["rms"].to_numpy(), int(pdf["frame"].iloc[0])
        limit = (blk + 1) * block_frames
        if blk == 0 and total <= max_s:
            return [(0.0, total)]
        cuts = []
        while cursor < total and round(cursor * fps) < limit:
            if total - cursor <= max_s:
                cuts.append((cursor, total))
                break
            nxt = _cut(cursor, rms, first, n_frames, fps, p)
            cuts.append((cursor, nxt))
            cursor = nxt
        return cuts

    def summarise(key, pdf):
        """Exit frame for every frame the block can be entered at, run-length coded."""
        pdf = pdf.sort_values("frame")
        blk, memo, runs = int(key[1]), {}, []
        total, n_frames = float(pdf["total_s"].iloc[0]), int(pdf["n_frames"].iloc[0])
        rms, first, limit = pdf["rms"].to_numpy(), int(pdf["frame"].iloc[0]), (blk + 1) * block_frames
        lo = blk * block_frames
        for f in [0] if blk == 0 else range(lo, min(lo + reach, n_frames)):
            path, g = [], f
            while g >= 0 and g < limit and g not in memo:
                path.append(g)
                cur = g / fps
                g = -1 if total - cur <= max_s else int(round(_cut(cur, rms, first, n_frames, fps, p) * fps))
                if g >= 0 and g / fps >= total:
                    g = -1
            end = memo.get(g, g)
            for q in path:
                memo[q] = end
            if runs and runs[-1][2] == end:
                runs[-1][1] = f
            else:
                runs.append([f, f, end])
        return pd.DataFrame([(key[0], key[1], *r) for r in runs], columns=["rec", "blk", "lo", "hi", "leave"])

    def chain(key, pdf):
        out, at = [], 0
        for blk, group in pdf.sort_values(["blk", "lo"]).groupby("blk"):
            if at < 0:
                break
            if at >= (blk + 1) * block_frames:  # jumped over: cannot happen with 2 * reach blocks
                continue
            out.append((key[0], blk, at))
            at = int(group.loc[(group["lo"] <= at) & (at <= group["hi"]), "leave"].iloc[0])
        return pd.DataFrame(out, columns=["rec", "blk", "entry"])

    long = blocks.filter(F.col("n_frames") > block_frames)
    tables = long.groupBy("rec", "blk").applyInPandas(
        summarise, _schema(frames, "rec") + ", blk long, lo long, hi long, leave long"
    )
    entry = tables.groupBy("rec").applyInPandas(chain, _schema(frames, "rec") + ", blk long, entry long")

    def emit(key, pdf):
        pdf = pdf.sort_values("frame")
        blk = int(key[1])
        at = pdf["entry"].iloc[0]
        if pd.isna(at) and blk > 0:
            cuts = []
        else:
            cuts = walk(pdf, blk, 0.0 if pd.isna(at) else at / fps)
        return pd.DataFrame([(key[0], blk, k, a, b) for k, (a, b) in enumerate(cuts)],
                            columns=["rec", "blk", "k", "start_s", "end_s"])

    cuts = blocks.join(entry, ["rec", "blk"], "left").groupBy("rec", "blk").applyInPandas(
        emit, _schema(frames, "rec") + ", blk long, k long, start_s double, end_s double"
    )
    return ordered(cuts, ["rec"], ["blk", "k"], F.col("blk"), position="index").select("rec", "index", "start_s", "end_s")


def _schema(df: DataFrame, *cols: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)
