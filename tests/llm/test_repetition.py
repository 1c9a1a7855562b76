"""Repetition coverage against a count by hand."""

from collections import Counter

from lexspan.llm.repetition import LIMITS, LINE_LIMIT, measure, op3_repetition_coverage, repetition_rules

from .conftest import EDGE


def by_hand(text):
    raw = (text or "").encode()
    w = raw.split()
    chars = [len(x.decode()) for x in w]
    total = sum(chars)

    def inside(n, first):
        seen, count, mark = set(), Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if (count[g] > 1) if first else g in seen:
                mark.update(range(i, i + n))
            seen.add(g)
        return mark

    seen, again, again_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        own = line.encode().split()
        if own and line in seen:
            again, again_chars = again + 1, again_chars + sum(len(x.decode()) for x in own)
        seen.add(line)
    covers = [sum(chars[i] for i in inside(n, False)) / max(1, total) for n in LIMITS]
    repeat = len(inside(3, True))
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    line = again_chars / max(1, total)
    kept = not failed and line <= LINE_LIMIT and all(c <= m for c, m in zip(covers, LIMITS.values(), strict=True))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return (len(w), total, symbols, again, repeat, line, *covers, failed, kept)


def close(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def test_edge_cases(edge):
    assert close(map(tuple, repetition_rules(edge).collect())) == close((i, *by_hand(t)) for i, t in EDGE)
    assert repetition_rules(edge.limit(0)).collect() == []


def test_small_slices():
    texts = ["a b c d e f a b c d e f g", "x x x x x x x x x x x x", "q", "", None]
    got = measure(texts, LIMITS)
    assert [got["n_repeat_words"][i] for i in range(5)] == [by_hand(t)[4] for t in texts]


def test_query(spark, sf, documents):
    assert close(map(tuple, op3_repetition_coverage(spark, sf).collect())) == close((i, *by_hand(t)) for i, t in documents)
