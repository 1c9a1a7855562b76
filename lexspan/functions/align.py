"""Edit distances and word alignment, many pairs at once (Arrow, numpy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CELLS = 4_000_000  # matrix cells held at once per Python worker
#: Pairs of a step, steps x pairs, and numbers of bits that a call holds; symbols that are coded at once.
_LANES, _STEPPED, _MASKS, _SYMBOLS = 1_024, 1_000_000, 1 << 20, 1_500_000
#: Pairs whose shorter side has more blocks of 64 symbols go one by one, in blocks of so many bits.
_BLOCKS, _LONG_BITS = 8, 16_384


# --- distances ----------------------------------------------------------------
# Pairs lie one after another: the codes of all references, of all hypotheses, and where each begins.


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, place in it) of every symbol of pairs of these sizes."""
    pair = np.repeat(np.arange(len(sizes)), sizes)
    return pair, np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _shared_ends(ref: np.ndarray, r_at: np.ndarray, hyp: np.ndarray, h_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common prefix of each pair, and of the common suffix of what follows it."""

    def run(short: np.ndarray, r_from: np.ndarray, h_from: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros(len(short), np.int64)
        some = np.flatnonzero(short)
        if len(some):
            pair, place = _ragged(short[some])
            same = ref[r_from[some][pair] + step * place] == hyp[h_from[some][pair] + step * place]
            first = np.cumsum(short[some]) - short[some]
            out[some] = np.minimum.reduceat(np.where(same, short[some][pair], place), first)
        return out

    n, m = np.diff(r_at), np.diff(h_at)
    short = np.minimum(n, m)
    pre = run(short, r_at[:-1], h_at[:-1], 1)
    return pre, run(short - pre, r_at[1:] - 1, h_at[1:] - 1, -1)


def _one_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of a long pair, ``a`` the shorter: as in ``_block_distances``, with long integers as columns of bits."""
    add, sub = [1] * len(b), [0] * len(b)
    for at in range(0, len(a), _LONG_BITS):
        part = a[at : at + _LONG_BITS].tolist()
        places: dict[int, int] = {}
        for i, x in enumerate(part):
            places[x] = places.get(x, 0) | 1 << i
        top, full = len(part) - 1, (1 << len(part)) - 1
        pv, mv = full, 0
        for j, x in enumerate(b.tolist()):
            eq = places.get(x, 0)
            xv = eq | mv
            eq |= sub[j]
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (full & ~(xh | pv)), pv & xh
            up, down = ph >> top & 1, mh >> top & 1
            ph, mh = ph << 1 & full | add[j], mh << 1 & full | sub[j]
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
            add[j], sub[j] = up, down
    return len(a) + sum(add) - sum(sub)


def _block_distances(short: np.ndarray, s_at: np.ndarray, n: np.ndarray, long: np.ndarray, l_at: np.ndarray, m: np.ndarray, n_codes: int,
                     steps: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Distances of pairs at once, the longest texts first; ``short`` goes in blocks of 64 rows.

    A column of the matrix is one step, a block's rows are the bits of two numbers: where a cell is one more than the
    cell above it, and where one less (Myers, Hyyrö). ``steps`` takes these numbers for columns 1 and up, if there is one block.
    """
    b, wide, high = len(n), int(m[0]), int(n.max())
    lane, place = _ragged(n)
    symbol = short[s_at[lane] + place]
    t_lane, t_place = _ragged(m)
    t_symbol = long[l_at[t_lane] + t_place]
    if n_codes * b <= _MASKS:  # a number for every symbol of every pair
        size = (n_codes + 1) * b
        s_key, t_key, none = symbol * b + lane, t_symbol * b + t_lane, n_codes * b
    else:  # only for the symbols of the shorter sides
        keys, s_key = np.unique(lane * n_codes + symbol, return_inverse=True)
        size = none = len(keys)
        size += 1
        wanted = t_lane * n_codes + t_symbol
        t_key = np.minimum(np.searchsorted(keys, wanted), none - 1)
        t_key = np.where(keys[t_key] == wanted, t_key, none)
    rows = np.full((high, b), none, np.int64)
    rows[place, lane] = s_key
    columns = np.full((wide, b), none, np.int64)
    columns[t_place, t_lane] = t_key
    one = np.uint64(1)
    # what each column hands from a block to the next: one more, or one less; after a pair's last block, the steps of its last row
    add = (np.arange(wide)[:, None] < m).astype(np.uint64)
    sub = np.zeros_like(add)
    for at in range(0, high, 64):
        masks = np.zeros(size, np.uint64)
        for i in range(at, min(high, at + 64)):
            masks[rows[i]] |= np.uint64(1 << (i - at))
        masks[none] = 0
        some = np.flatnonzero(n > at)
        to, every = int(m[some[0]]), len(some) == b
        live = np.searchsorted(-m[some], -np.arange(to), side="left").tolist()
        top = (np.minimum(n[some] - at, 64) - 1).astype(np.uint64)
        ups, downs, keys = (add, sub, columns) if every else (add[:to, some], sub[:to, some], columns[:to, some])
        pv, mv = np.full(len(some), ~np.uint64(0)), np.zeros(len(some), np.uint64)
        x, y, z = (np.empty(len(some), np.uint64) for _ in range(3))
        for j, k in enumerate(live):
            p, q, t, h, g, up, down, last = pv[:k], mv[:k], x[:k], y[:k], z[:k], ups[j, :k], downs[j, :k], top[:k]
            eq = masks.take(keys[j, :k])
            xv = eq | q
            eq |= down
            np.bitwise_and(eq, p, out=t)
            t += p
            t ^= p
            t |= eq
            np.bitwise_or(t, p, out=h)
            np.invert(h, out=h)
            h |= q
            t &= p
            np.left_shift(h, one, out=g)
            g |= up
            np.right_shift(h, last, out=up)
            up &= one
            np.left_shift(t, one, out=h)
            h |= down
            np.right_shift(t, last, out=down)
            down &= one
            np.bitwise_or(xv, g, out=p)
            np.invert(p, out=p)
            p |= h
            np.bitwise_and(g, xv, out=q)
            if steps is not None:
                steps[0][j + 1, :k], steps[1][j + 1, :k] = p, q
        if not every:
            add[:to, some], sub[:to, some] = ups, downs
    return n + add.sum(axis=0).astype(np.int64) - sub.sum(axis=0).astype(np.int64)


def distances(ref: np.ndarray, r_at: np.ndarray, hyp: np.ndarray, h_at: np.ndarray, n_codes: int) -> np.ndarray:
    """Edit distance of every pair; symbols are codes below ``n_codes``."""
    pre, suf = _shared_ends(ref, r_at, hyp, h_at)
    n, m = np.diff(r_at) - pre - suf, np.diff(h_at) - pre - suf
    out = np.maximum(n, m)
    both = np.concatenate([ref, hyp])
    r_from, h_from = r_at[:-1] + pre, len(ref) + h_at[:-1] + pre
    turned = n > m
    s_at, l_at = np.where(turned, h_from, r_from), np.where(turned, r_from, h_from)
    n, m = np.minimum(n, m), np.maximum(n, m)
    todo = np.flatnonzero((n > 0) & (n <= 64 * _BLOCKS))
    todo = todo[np.argsort(-m[todo], kind="stable")]
    at = 0
    while at < len(todo):
        some = todo[at : at + min(_LANES, max(16, _STEPPED // int(m[todo[at]])))]
        out[some] = _block_distances(both, s_at[some], n[some], both, l_at[some], m[some], n_codes)
        at += len(some)
    for k in np.flatnonzero(n > 64 * _BLOCKS):
        out[k] = _one_distance(both[s_at[k] : s_at[k] + n[k]], both[l_at[k] : l_at[k] + m[k]])
    return out


def _lists(words: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All words of an array of lists, and where each list begins."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return words.flatten(), at


def _word_codes(refs: pa.Array, hyps: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of words; a NULL equals no other word."""
    coded = pa.concat_arrays([refs, hyps]).dictionary_encode()
    n = len(coded.dictionary)
    codes = pc.fill_null(coded.indices, n).to_numpy(zero_copy_only=False).astype(np.int64)
    hyp = codes[len(refs) :]
    return codes[: len(refs)], np.where(hyp == n, n + 1, hyp), n + 2


def _parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of normalised texts, and where each text begins."""
    words, at = _lists(pc.split_pattern(pc.fill_null(texts, ""), " "))
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    return (words, at) if some.all() else (words.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[at])


def words_and_steps(ref_norm: pa.Array, ops: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Reference words and where each text's begin, letters of the steps and where each pair's begin."""
    words, at = _parted(ref_norm)
    ops = pc.fill_null(ops, "")
    s_at = np.concatenate([[0], np.cumsum(pc.binary_length(ops).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return words, at, np.frombuffer("".join(ops.to_pylist()).encode("ascii"), np.uint8), s_at


def _coded_words(refs: pa.Array, hyps: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and beginnings of lists of words, or of the words of normalised texts."""

    def parts(side: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return _lists(side) if pa.types.is_list(side.type) or pa.types.is_large_list(side.type) else _parted(side)

    (r, r_at), (h, h_at) = parts(refs), parts(hyps)
    ref, hyp, n = _word_codes(r, h)
    return ref, r_at, hyp, h_at, n


def _coded_letters(refs: pa.Array, hyps: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and beginnings of texts letter by letter."""
    refs, hyps = pc.fill_null(refs, ""), pc.fill_null(hyps, "")
    at = [np.concatenate([[0], np.cumsum(pc.utf8_length(side).to_numpy(zero_copy_only=False))]).astype(np.int64) for side in (refs, hyps)]
    letters = np.frombuffer("".join(refs.to_pylist() + hyps.to_pylist()).encode("utf-32-le"), np.uint32)
    known = np.zeros(0x110000, np.int64)
    known[letters] = 1
    n = int(known.sum())
    known[known > 0] = np.arange(n)
    codes = known[letters]
    return codes[: at[0][-1]], at[0], codes[at[0][-1] :], at[1], n


def _in_parts(coded, make, refs: pa.Array, hyps: pa.Array) -> list:
    """``make`` of the codes of some pairs after the other, so that long texts don't swell what is held at once."""
    size = pc.list_value_length if pa.types.is_list(refs.type) or pa.types.is_large_list(refs.type) else pc.binary_length
    ends = np.cumsum(sum(pc.fill_null(size(side), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1 for side in (refs, hyps)))
    out: list = []
    at = 0
    while at < len(refs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SYMBOLS, side="right")))
        out.append(make(*coded(refs.slice(at, to - at), hyps.slice(at, to - at))))
        at = to
    return out


def _distance_column(coded, refs: pa.Array, hyps: pa.Array) -> pa.Array:
    """Distances, NULL where a side is NULL."""
    found = np.concatenate([np.zeros(0, np.int64), *_in_parts(coded, distances, refs, hyps)]).astype(np.int32)
    return pc.if_else(pc.and_(refs.is_valid(), hyps.is_valid()), pa.array(found), pa.scalar(None, pa.int32()))


@F.arrow_udf(T.IntegerType())
def list_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Substitutions + deletions + insertions between two word arrays."""
    return _distance_column(_coded_words, ref, hyp)


@F.arrow_udf(T.IntegerType())
def word_distance(ref_norm: pa.Array, hyp_norm: pa.Array) -> pa.Array:
    """Substitutions + deletions + insertions between the words of two normalised strings."""
    return _distance_column(_coded_words, ref_norm, hyp_norm)


@F.arrow_udf(T.IntegerType())
def letter_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Substitutions + deletions + insertions between the letters of two strings."""
    return _distance_column(_coded_letters, ref, hyp)


def with_edit_distance(df: DataFrame, ref: Column, hyp: Column, out: str = "errors", size: str = "ref_len") -> DataFrame:
    """Distance of two word arrays, and the size of the first."""
    staged = df.withColumn("__r", ref).withColumn("__h", hyp)
    return staged.withColumn(out, list_distance("__r", "__h")).withColumn(size, F.size("__r")).drop("__r", "__h")


def char_edit_distance(ref_norm: Column, hyp_norm: Column) -> Column:
    return letter_distance(ref_norm, hyp_norm)


# --- alignment --------------------------------------------------------------
# One letter per step: E equal, S substitute, D delete, I insert. The optimal
# path is fixed by one rule: common prefix and suffix are taken first; walking
# back from the end, delete when the cell above is one cheaper, else insert when
# the cell to the left lies one below its diagonal, else go diagonally.


def _next_row(prev: np.ndarray, ref_word: np.ndarray, hyps: np.ndarray, i: int) -> np.ndarray:
    """Row i of the distance matrix for a whole batch of pairs."""
    m = hyps.shape[1]
    row = np.empty_like(prev)
    row[:, 0] = i
    np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (hyps != ref_word[:, None]), out=row[:, 1:])
    ramp = np.arange(m + 1, dtype=prev.dtype)
    row -= ramp
    np.minimum.accumulate(row, axis=1, out=row)
    row += ramp
    return row


def _walk(cur: np.ndarray, up: np.ndarray, i: int, j: int, ref, hyp) -> tuple[str, int, int]:
    if j == 0 or (i > 0 and cur[j] == up[j] + 1):
        return "D", i - 1, j
    if i == 0 or (j > 1 and cur[j - 1] == up[j - 1] - 1):
        return "I", i, j - 1
    return ("E" if ref[i - 1] == hyp[j - 1] else "S"), i - 1, j - 1


def _ops_one(ref: np.ndarray, hyp: np.ndarray) -> str:
    """A pair too large for a full matrix: keep every k-th row, rebuild between."""
    n, m = len(ref), len(hyp)
    step = max(1, int(np.sqrt(n)))
    row = np.arange(m + 1, dtype=np.int32)[None, :]
    kept = {0: row}
    for i in range(1, n + 1):
        row = _next_row(row, ref[i - 1 : i], hyp[None, :], i)
        if i % step == 0:
            kept[i] = row
    out: list[str] = []
    i, j = n, m
    while i > 0:
        base = (i - 1) // step * step
        rows = [kept[base][0]]
        for r in range(base + 1, i + 1):
            rows.append(_next_row(rows[-1][None, :], ref[r - 1 : r], hyp[None, :], r)[0])
        while i > base:
            op, i, j = _walk(rows[i - base], rows[i - base - 1], i, j, ref, hyp)
            out.append(op)
    out.append("I" * j)
    return "".join(out)[::-1]


def _ops_batch(refs: list[np.ndarray], hyps: list[np.ndarray]) -> list[str]:
    """Full-matrix alignment of many pairs at once, padded to a common shape."""
    b = len(refs)
    n_len = np.array([len(r) for r in refs])
    m_len = np.array([len(h) for h in hyps])
    n, m = int(n_len.max()), int(m_len.max())
    ref = np.full((b, n), -1, dtype=np.int64)
    hyp = np.full((b, m), -2, dtype=np.int64)
    for k in range(b):
        ref[k, : n_len[k]] = refs[k]
        hyp[k, : m_len[k]] = hyps[k]
    dist = np.empty((n + 1, b, m + 1), dtype=np.int32)
    dist[0] = np.arange(m + 1)
    for i in range(1, n + 1):
        dist[i] = _next_row(dist[i - 1], ref[:, i - 1], hyp, i)

    ops = np.full((b, n + m), ord(" "), dtype=np.uint8)
    i, j, lane = n_len.copy(), m_len.copy(), np.arange(b)
    for s in range(n + m):
        live = (i > 0) | (j > 0)
        if not live.any():
            break
        iu, jl = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        here, above = dist[i, lane, j], dist[iu, lane, j]
        left, diag = dist[i, lane, jl], dist[iu, lane, jl]
        delete = (i > 0) & ((j == 0) | (here == above + 1))
        insert = ~delete & (j > 0) & ((i == 0) | ((j > 1) & (left == diag - 1)))
        across = live & ~delete & ~insert
        same = across.copy()
        if n and m:
            same &= ref[lane, np.minimum(iu, n - 1)] == hyp[lane, np.minimum(jl, m - 1)]
        code = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(same, ord("E"), ord("S"))))
        ops[:, s] = np.where(live, code, ord(" "))
        i = i - (delete | across)
        j = j - (insert | across)
    return [ops[k][::-1].tobytes().decode("ascii").strip() for k in range(b)]


def _bit_ops(ref: np.ndarray, r_from: np.ndarray, n: np.ndarray, hyp: np.ndarray, h_from: np.ndarray, m: np.ndarray, n_codes: int) -> list[str]:
    """Alignment of many pairs at once, references of 64 words at most: the walk reads the bits of ``_block_distances``."""
    b, wide, high = len(n), int(m[0]), int(n.max())
    ups, downs = np.full((wide + 1, b), ~np.uint64(0)), np.zeros((wide + 1, b), np.uint64)
    _block_distances(ref, r_from, n, hyp, h_from, m, n_codes, (ups, downs))
    i, j, lane, one = n.copy(), m.copy(), np.arange(b), np.uint64(1)
    ops = np.full((wide + high, b), ord(" "), np.uint8)
    for s in range(wide + high):
        live = (i > 0) | (j > 0)
        if not live.any():
            break
        row = np.maximum(i - 1, 0).astype(np.uint64)
        left = np.maximum(j - 1, 0)
        delete = (i > 0) & ((ups[j, lane] >> row & one) == 1)
        insert = live & ~delete & ((i == 0) | ((downs[left, lane] >> row & one) == 1))
        across = live & ~delete & ~insert
        same = ref[np.where(across, r_from + i - 1, 0)] == hyp[np.where(across, h_from + j - 1, 0)]
        code = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(same, ord("E"), ord("S"))))
        ops[s] = np.where(live, code, ord(" "))
        i = i - (delete | across)
        j = j - (insert | across)
    flat = ops[::-1].T.tobytes().decode("ascii")
    size = wide + high
    return [flat[k * size : (k + 1) * size].lstrip() for k in range(b)]


def align_codes(ref: np.ndarray, r_at: np.ndarray, hyp: np.ndarray, h_at: np.ndarray, n_codes: int) -> list[str]:
    """Operation string of every pair of coded words."""
    pre, suf = _shared_ends(ref, r_at, hyp, h_at)
    n, m = np.diff(r_at) - pre - suf, np.diff(h_at) - pre - suf
    r_from, h_from = r_at[:-1] + pre, h_at[:-1] + pre
    mids = ["D" * int(a) + "I" * int(c) if a == 0 or c == 0 else "" for a, c in zip(n, m)]
    todo = np.flatnonzero((n > 0) & (n <= 64) & (m > 0))
    todo = todo[np.argsort(-m[todo], kind="stable")]
    at = 0
    while at < len(todo):
        to = min(len(todo), at + max(16, _STEPPED // int(m[todo[at]])), at + _LANES)
        some = todo[at:to]
        for k, ops in zip(some.tolist(), _bit_ops(ref, r_from[some], n[some], hyp, h_from[some], m[some], n_codes)):
            mids[k] = ops
        at = to
    for k in np.flatnonzero((n > 64) & (m > 0)).tolist():
        r, h = ref[r_from[k] : r_from[k] + n[k]], hyp[h_from[k] : h_from[k] + m[k]]
        mids[k] = _ops_one(r, h) if (n[k] + 1) * (m[k] + 1) > _CELLS else _ops_batch([r], [h])[0]
    return ["E" * a + mid + "E" * c for a, mid, c in zip(pre.tolist(), mids, suf.tolist())]


def align_words(pairs: list[tuple[list[str], list[str]]]) -> list[str]:
    """Operation string of every (reference, hypothesis) pair of word lists."""
    of = pa.list_(pa.string())
    return align_codes(*_coded_words(pa.array([r for r, _ in pairs], of), pa.array([h for _, h in pairs], of)))


@F.arrow_udf(T.StringType())
def alignment_ops(ref_norm: pa.Array, hyp_norm: pa.Array) -> pa.Array:
    """Alignment of two normalised strings as one letter per step."""
    found = _in_parts(_coded_words, align_codes, pc.fill_null(ref_norm, ""), pc.fill_null(hyp_norm, ""))
    return pa.array([ops for part in found for ops in part], pa.string())


def alignment_chunks(ops: Column) -> Column:
    """Runs of equal steps as ``array<struct<type, ref_start, ref_end, hyp_start, hyp_end>>``."""
    runs = F.regexp_extract_all(ops, F.lit("(E+|S+|D+|I+)"), 1)

    def chunk(run: Column, i: Column) -> Column:
        before = F.array_join(F.slice(runs, F.lit(1), i), "")
        through = F.concat(before, run)
        n_ref = lambda s: F.length(F.translate(s, "I", ""))
        n_hyp = lambda s: F.length(F.translate(s, "D", ""))
        kind = F.substring(run, 1, 1)
        return F.struct(
            F.when(kind == "E", "equal").when(kind == "S", "substitute")
            .when(kind == "D", "delete").otherwise("insert").alias("type"),
            n_ref(before).alias("ref_start"), n_ref(through).alias("ref_end"),
            n_hyp(before).alias("hyp_start"), n_hyp(through).alias("hyp_end"),
        )

    return F.when(ops == "", F.array().cast(
        "array<struct<type:string,ref_start:int,ref_end:int,hyp_start:int,hyp_end:int>>"
    )).otherwise(F.transform(runs, chunk))


def ops_errors(ops: Column) -> Column:
    return F.length(F.translate(ops, "E", ""))
