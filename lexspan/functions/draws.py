"""Draws of a resampling that any engine can repeat: parts of ``md5(seed-rep-q)``, for whole arrays at once."""

from __future__ import annotations

import hashlib

import numpy as np

_K = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Digests computed at once: their numbers stay in a core's cache.
_STEP = 8192


def _md5(words: list[np.ndarray | np.uint32], n: int) -> list[np.ndarray]:
    """The four numbers of the md5 of n messages of one block each. ``words``: the block's 16 numbers, arrays or one for all."""
    a, b, c, d = (np.full(n, x) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if isinstance(words[g], np.ndarray):
            np.add(f, words[g], out=f)
            np.add(f, _K[i], out=f)
        else:
            np.add(f, np.uint32((int(words[g]) + int(_K[i])) & 0xFFFFFFFF), out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [x + s for x, s in zip((a, b, c, d), _START)]


def _digests(prefix: bytes, first: int, n: int, digits: int) -> list[np.ndarray]:
    """md5 of the prefix with each of n following numbers, all of so many digits."""
    head = len(prefix)
    size = head + digits
    if size > 55:
        raise ValueError("a message of one block only")
    block = np.zeros(64, np.uint8)
    block[:head] = np.frombuffer(prefix, np.uint8)
    block[size] = 0x80
    block[56:58] = (8 * size & 255, 8 * size >> 8)
    words: list = list(block.view("<u4"))
    q = np.arange(first, first + n, dtype=np.uint32)
    for at in range(size - 1, head - 1, -1):
        letter = (q % np.uint32(10) + np.uint32(48)) << np.uint32(8 * (at % 4))
        words[at // 4] = words[at // 4] | letter
        q //= np.uint32(10)
    return _md5(words, n)


def numbered(prefixes: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The first four hex digits, as numbers, of the md5 of each prefix with 1, 2 .. its count behind it: all of one prefix after the other."""
    row = np.repeat(np.arange(len(prefixes)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    head = np.array([len(p) for p in prefixes], np.int64)
    digits = np.searchsorted(10 ** np.arange(1, 19), number, side="right") + 1
    out = np.empty(len(row), np.int64)
    kind = head[row] * 20 + digits if len(row) else row
    for k in np.unique(kind).tolist():
        some = np.flatnonzero(kind == k)
        size, more = divmod(k, 20)
        if size + more > 55:
            for i in some.tolist():
                out[i] = int(hashlib.md5(prefixes[row[i]] + str(number[i]).encode(), usedforsecurity=False).hexdigest()[:4], 16)
            continue
        of = np.flatnonzero(head == size)
        block = np.zeros((len(of), 64), np.uint8)
        block[:, :size] = np.frombuffer(b"".join([prefixes[i] for i in of.tolist()]), np.uint8).reshape(len(of), size)
        block[:, size + more] = 0x80
        block[:, 56], block[:, 57] = 8 * (size + more) & 255, 8 * (size + more) >> 8
        words, place = block.view("<u4"), np.empty(len(prefixes), np.int64)
        place[of] = np.arange(len(of))
        varies = range((size + more) // 4 + 1)
        for at in range(0, len(some), _STEP):
            part = some[at : at + _STEP]
            message: list = [words[place[row[part]], i] if i in varies else words[0, i] for i in range(16)]
            q = number[part].astype(np.uint32)
            for i in range(size + more - 1, size - 1, -1):
                message[i // 4] = message[i // 4] | (q % np.uint32(10) + np.uint32(48)) << np.uint32(8 * (i % 4))
                q //= np.uint32(10)
            first = _md5(message, len(part))[0]
            out[part] = (first & np.uint32(255)) << np.uint32(8) | first >> np.uint32(8) & np.uint32(255)
    return out


def draws(seed: int, rep: int, size: int) -> np.ndarray:
    """``size`` places below ``size``: draws 4q .. 4q + 3 are the parts of ``md5('seed-rep-q')``, eight hex digits each, modulo ``size``."""
    count = (size + 3) // 4
    out = np.empty((count, 4), np.int64)
    prefix = f"{seed}-{rep}-".encode()
    first = 0
    while first < count:
        digits = len(str(first))
        n = min(_STEP, count - first, 10**digits - first)
        for i, part in enumerate(_digests(prefix, first, n, digits)):
            out[first : first + n, i] = part.byteswap() % np.uint32(size)
        first += n
    return out.reshape(-1)[:size]
