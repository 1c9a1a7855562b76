"""The trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lexspan.llm.conversation_trie import op12_conversation_trie, prefix_trie, rebuilt_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, depth string, block string, n_convs string"


def grouped(rows):
    """Turns of each conversation; those of one number come in the order of the digest that the docstring names."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            out[conv].append((turn is not None, turn or 0, mark, role, text))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in out.items()}


def renewed(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(turns):
    members = defaultdict(list)
    for c, seq in turns.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []
    for path, who in members.items():
        inside = [p for p in members if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in who if len(turns[c]) == len(path))))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in inside if p)
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children[path]), sum(not children[p] for p in inside), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(4)


def same(df, turns):
    assert sorted(map(tuple, df.collect()), key=repr) == brute(turns)


@pytest.fixture(scope="module")
def random_rows():
    """Shared beginnings of all lengths, up to six blocks, with copies."""
    rng, rows = random.Random(3), []
    stems = [[(rng.choice(["user", "assistant"]), f"stem {i} turn {j} é") for j in range(45)] for i in range(3)]
    for c in range(60):
        cut = rng.choice([0, 1, 7, 8, 9, 16, 17, 33, 45])
        seq = rng.choice(stems)[:cut] + [("user", rng.choice(["a", "b"])) for _ in range(rng.choice([0, 0, 1, 2, 9]))]
        rows += [(c + 3, t, r, x) for t, (r, x) in enumerate(seq)]
    return rows


def test_long_and_shared(spark, random_rows):
    turns = grouped(random_rows)
    same(prefix_trie(frame(spark, random_rows)), turns)
    same(rebuilt_prefix_trie(frame(spark, random_rows)), renewed(turns))


def test_edge_cases(spark):
    """Null ids, turns, roles and texts, turns of one number, equal rows, an id without a family head, and one left without turns."""
    rows = [(0, 0, "user", "hi"), (0, 1, None, None), (0, None, "system", "first"), (0, None, "system", "also"), (5, 1, "user", "hi"), (5, 1, "user", "hi"), (5, 1, "assistant", "ho")]
    rows += [(7, 0, "user", "x"), (8, 0, "", None), (9, None, None, None), (11, 3, "user", "only"), (13, 3, "user", "only"), (14, 3, "user", "only"), (None, 0, "user", "lost"), (22, 0, "user", "y" * 200_000)]
    turns = grouped(rows)
    assert any(not x for x in renewed(turns).values())
    same(prefix_trie(frame(spark, rows)), turns)
    same(rebuilt_prefix_trie(frame(spark, rows)), renewed(turns))


def test_many_copies_and_empty(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(9_000) for t in range(1)]
    got = {r.depth: r for r in prefix_trie(frame(spark, rows)).collect()}
    assert got[0].n_convs == got[1].n_convs == 9_000 and got[0].n_leaves == 1 and got[1].saved_tokens == 8_999 * 2
    assert got[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(9_000))).encode()).hexdigest()
    assert prefix_trie(frame(spark, rows[:1]).limit(0)).collect() == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(op12_conversation_trie(spark, sf), renewed(grouped(rows)))
