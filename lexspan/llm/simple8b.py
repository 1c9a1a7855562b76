"""Simple-8b: many small integers in each 64-bit word, packed and unpacked with numpy.

A word's four high bits are its selector, the rest its values, the first one lowest.
Selector 0 is the escape: the next word is one raw 64-bit value. Selector 1 stands for 240
zeros; the others hold n values of 60 // n bits.

A block: header (magic "S8B1", documents, groups, ids, words), per document a flag (0: its id is
null), its id and its number of ids, per group of GROUP words the number of ids before it, then the
words. All integers are little-endian. The group offsets let a reader unpack any stretch of
a block by itself and place all values at once.
"""

from __future__ import annotations

import struct

import numpy as np

#: By selector: values in a word, bits of each. Fixed values of the coding.
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
GROUP = 1024
HEAD = struct.Struct("<4sIIQQ")
_SHIFTS = [np.arange(n, dtype=np.uint64) * np.uint64(b if n > 1 else 0) for n, b in zip(COUNTS, BITS, strict=True)]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the number of values before each of them (the raw word of an escape counts none, it comes after its value)."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    # by value: the densest selector that holds it, 16 for the escape
    need = np.searchsorted(np.array([1 << int(b) for b in BITS[1:]], np.uint64), v, side="right").astype(np.uint8) + 1
    most = {1: np.concatenate([need, np.ones(240, np.uint8)])}  # over the next k values; what is beyond the end fits anything
    step, picked = np.ones(n, np.int64), np.where(need > 15, 0, 15).astype(np.uint8)

    def over(k: int) -> np.ndarray:
        if k not in most:
            half = k // 2
            a, b = over(k - half), over(half)
            most[k] = np.maximum(a[: len(a) - half], b[k - half :][: len(a) - half]) if half else a
        return most[k]

    for selector in range(14, 0, -1):
        k = int(COUNTS[selector])
        fits = over(k)[:n] <= selector
        if not fits.any():
            break
        step[fits], picked[fits] = k, selector
    at, starts, steps = 0, [], step.tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    chosen = picked[starts]
    padded = np.concatenate([v, np.zeros(240, np.uint64)])
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(chosen == 0)])[:-1]
    out = np.zeros(len(starts) + int((chosen == 0).sum()), np.uint64)
    before = np.full(len(out), n, np.int64)
    before[place] = starts
    before[place[chosen == 0] + 1] = starts[chosen == 0] + 1
    out[place] = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        mine = chosen == selector
        if selector == 0:
            out[place[mine] + 1] = v[starts[mine]]
        elif selector > 1:
            many = padded[starts[mine][:, None] + np.arange(COUNTS[selector])] << _SHIFTS[selector]
            out[place[mine]] |= np.bitwise_or.reduce(many, axis=1)
    return out, before


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of these words. Values are placed by selector, not one by one."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0).tolist():  # the word after an escape is raw, whatever its bits
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    if len(heads) and heads[-1] == len(words) - 1 and not selector[heads[-1]]:
        heads = heads[:-1]  # an escape cut off from its value
    picked = selector[heads]
    count = COUNTS[picked]
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(picked):
        mine = heads[picked == s]
        if s == 0:
            out[start[picked == s]] = words[mine + 1]
        elif s > 1:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            out[start[picked == s][:, None] + np.arange(COUNTS[s])] = (words[mine][:, None] >> _SHIFTS[s]) & mask
    return out[:n]


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    packed, before = pack(ids)
    offsets = before[::GROUP].astype("<u8")
    return b"".join([
        HEAD.pack(b"S8B1", len(doc_ids), len(offsets), len(ids), len(packed)),
        np.array([i is not None for i in doc_ids], np.uint8).tobytes(),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<u8").tobytes(),
        offsets.tobytes(),
        packed.astype("<u8").tobytes(),
    ])


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, all ids."""
    magic, docs, groups, n, n_words = HEAD.unpack_from(block)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b block")
    at = HEAD.size
    flags = np.frombuffer(block, np.uint8, docs, at)
    ids = np.frombuffer(block, "<i8", docs, at := at + docs)
    lengths = np.frombuffer(block, "<u8", docs, at := at + 8 * docs)
    words = np.frombuffer(block, "<u8", n_words, at + 8 * docs + 8 * groups)
    return [i if f else None for i, f in zip(ids.tolist(), flags.tolist(), strict=True)], lengths.astype(np.int64), unpack(words, n)


def read_group(block: bytes, group: int) -> tuple[int, np.ndarray]:
    """One group of words alone: the number of ids before it, and its ids; an escape may reach over the group's end by its raw word."""
    _, docs, groups, n, n_words = HEAD.unpack_from(block)
    at = HEAD.size + 17 * docs
    offsets = np.append(np.frombuffer(block, "<u8", groups, at).astype(np.int64), n)
    words = np.frombuffer(block, "<u8", n_words, at + 8 * groups)
    skip = _ends_in_escape(words, group * GROUP)
    part = words[group * GROUP + skip : (group + 1) * GROUP + 1]
    start, end = int(offsets[group]), int(offsets[group + 1])
    return start, unpack(part, end - start)


def _ends_in_escape(words: np.ndarray, at: int) -> int:
    """Whether the word at ``at`` is the raw one of an escape: so it is after an odd run of words that look like escapes."""
    run = 0
    while at - run > 0 and not int(words[at - run - 1]) >> 60:
        run += 1
    return run % 2
