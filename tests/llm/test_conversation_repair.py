"""Repairs against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lexspan.llm import conversation_repair
from lexspan.llm.conversation_repair import NEVER, auctioned, damaged, op13_conversation_repair, repair_report, repaired, table, traced

SCHEMA = "conv_id long, turn long, role string, text string, block string, cost string, edits string, mark string"


def states_search(word):
    """(cost, audit) by a table from the end; costs and strings are compared as they stand."""
    then = {"^": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    after = {"^": (0, ""), "a": (0, ""), "u": (2, "I"), "s": (4, "II")}
    for letter in reversed(word):
        direct = {}
        for q in then:
            ways = [(3 + after[q][0], "D" + after[q][1])]
            if letter != "x":
                cut = letter.isupper()
                for x, to in then[q].items():
                    if x == letter.lower():
                        ways.append((cut + after[to][0], "K" + after[to][1]))
                    if x != "s":
                        ways.append((2 + cut + after[to][0], "R" + after[to][1]))
            direct[q] = min(ways)
        after = {}
        for q in then:
            ways, now = [direct[q]], q
            for k in (1, 2):
                now = "a" if now == "u" else "u"
                ways.append((2 * k + direct[now][0], "I" * k + direct[now][1]))
            after[q] = min(ways)
    return after["^"]


def test_auction_and_trace():
    rng = random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("suuuaaaoxSUAO") for _ in range(rng.randint(0, 14)))
        assert (auctioned(word, None)[0], traced(word, None, 0)[0]) == states_search(word)


def test_blocks_chain(monkeypatch):
    """Tables of blocks, chained from the end, then traces with the prices found: as the whole word."""
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("suuuaaaoxSUAO") for _ in range(rng.randint(1, 40)))
        parts = [word[i : i + 7] for i in range(0, len(word), 7)]
        price, exits = table(parts[-1], True), [None]
        for part in reversed(parts[:-1]):
            exits.append(tuple(price))
            costs = table(part, False)
            price = [min(min(costs[4 * s + t] + price[t] for t in range(4)), NEVER) for s in range(4)]
        state, out = 0, ""
        for part, leave in zip(parts, reversed(exits), strict=True):
            edits, state = traced(part, leave, state)
            out += edits
        assert (price[0], out) == states_search(word)


def brute(rows, ids=None):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = " " if role is None else role, " " if text is None else text
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by[c].append((turn is not None, turn or 0, mark, role, text, turn))
    out = {}
    for c in ids if ids is not None else by:
        mine, seen, word, count = sorted(by.get(c, [])), set(), "", defaultdict(int)
        for *_, role, text, _ in mine:
            tail = text.rstrip(" \t\n\x0b\f\r")[-1:]
            fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            word += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        firsts = [r[3][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        turns = {r[5] for r in mine if r[5] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = states_search(word)
        left, lines, todo = iter(mine), [], len(audit.replace("D", "")) % 2
        for e in audit:
            *_, role, text, _ = next(left) if e != "I" else (None, "", None)
            if e != "D":
                lines.append((role if e == "K" else "user" if (len(lines) - todo) % 2 == 0 else "assistant") + ":" + text)
        roles = "".join(x[0] for x in lines)
        assert re.fullmatch("(s?(ua)+)?", roles)
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(4)


def same(df, want):
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == {c: v[:-1] for c, v in want.items()}


ODD = [
    (1, 0, "user", "hi."), (1, 1, None, None), (1, None, "assistant", "no turn"), (1, None, "assistant", "no turn"), (1, 3, "user", " \t\n"), (1, 3, "user", "hi."), (1, 3, "tool", "x!"),
    (2, None, None, None), (3, 5, "", "empty role."), (3, 9, "assistant", "a?"), (4, 0, "system", "only."), (5, 0, "user", "w " * 100_000 + "."), (None, 0, "user", "lost."),
    (6, 0, "System", "s."), (6, 1, "user", "u."), (6, 2, "assistant", "a. \x0b\f"), (6, 2, "assistant", "漢。"), (7, -3, "assistant", "x."), (7, 4, "assistant", "y."),
]


def test_odd_rows(spark):
    same(repair_report(frame(spark, ODD)), brute(ODD))
    got = defaultdict(list)
    for r in repaired(frame(spark, ODD)).orderBy("conv_id", "at").collect():
        got[r.conv_id].append(f"{r.role}:{r.text}")
    assert dict(got) == {c: v[-1] for c, v in brute(ODD).items() if v[-1]}
    assert repair_report(frame(spark, ODD).limit(0)).collect() == []
    nobody = repair_report(frame(spark, ODD).limit(0), spark.createDataFrame([(8,), (8,)], "conv_id long")).collect()
    assert [tuple(r) for r in nobody] == [(8, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation_in_blocks(spark, monkeypatch):
    """One conversation of many blocks beside short ones."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["same.", f"own {t}.", f"cut {t}", ""])) for t in range(1500)]
    rows += [(c, t, rng.choice(["user", "assistant", "system"]), f"{t}.") for c in range(2, 30) for t in range(rng.randint(1, 9))]
    same(repair_report(frame(spark, rows)), brute(rows))


def harmed(rows):
    out = []
    for c, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(c, turn, role, text)] * {0: 0, 3: 2}.get(f, 1)
    return out


def test_damage(spark):
    rows = ODD + [(c, t, "user", f"{t}. a! b?") for c in range(20, 40) for t in range(5)]
    assert sorted(map(tuple, damaged(frame(spark, rows)).collect()), key=repr) == sorted(harmed(rows), key=repr)


@pytest.mark.parametrize("table_set", ["sf0.001", "sf0.01"])
def test_query(spark, table_set):
    sf = f"/root/testdata/{table_set}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(op13_conversation_repair(spark, sf), brute(harmed(rows), {r[0] for r in rows}))
    assert conversation_repair.BLOCK == 256
