"""Cheapest repair of a conversation's structure, found by auction.

A conversation's repair is a path through a lattice: a node is a row and what has been said
so far (nothing, a system turn, a user turn, an assistant turn); its arcs keep, rerole or
delete the row, or insert a turn, at integer costs. The auction holds a price for each node, never
above the cost of any way to the end. A path grows from an origin: its last node either goes
on along an arc whose cost is exactly the difference of prices (extension), or, where none is, its
price rises to the best offer and the path gives the node up (contraction). Origins are taken from
the last row to the first, so a path ends as soon as it meets a node with a final price. With final
prices the tight arcs are all cheapest repairs; following them, least letter first, gives the
repair that is least in ASCII order.

A conversation is dealt into blocks of rows, so none is too long for a task: each block is
auctioned for every way to leave it, the small tables are chained from the end, and then
each block is auctioned with its true prices at the end and traced from every way to enter it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import settled
from lexspan.llm.conversation_trie import CRC32
from lexspan.operators.ordered import ordered
from lexspan.session import ship_package

#: Rows of a conversation that are auctioned together.
BLOCK = 256
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What has been said: nothing, system, user, assistant. A conversation may end at the first and the last.
STATES = range(4)
ENDS = (0, 3)
#: The state after a turn that is added or reroled: a user's, but after a user's an assistant's.
NEXT = (2, 2, 3, 2)
NEVER = 1 << 60
_SPACES = " \t\n\x0b\f\r"


def kept(letter: str, state: int) -> int | None:
    """The state after a kept row with this initial, None where it may not stand."""
    if letter == "s":
        return 1 if state == 0 else None
    if letter == "u":
        return 2 if state != 2 else None
    return 3 if letter == "a" and state == 2 else None


def arcs(word: str, row: int, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, row, state) of the ways on, in ASCII order. A letter stands for a row: x must go, capitals are truncated."""
    out = []
    if row < len(word):
        letter = word[row]
        out.append(("D", DELETE, row + 1, state))
    out.append(("I", INSERT, row, NEXT[state]))
    if row < len(word) and letter != "x":
        more = TRUNCATED if letter.isupper() else 0
        to = kept(letter.lower(), state)
        if to is not None:
            out.append(("K", more, row + 1, to))
        out.append(("R", REROLE + more, row + 1, NEXT[state]))
    return out


@lru_cache(200_000)
def auctioned(word: str, exits: tuple[int, ...] | None) -> tuple[int, ...]:
    """Final prices of all nodes, row by row; NEVER where the exits can't be reached.

    ``exits``: prices at the end of the block by state. None: the conversation ends with the block.
    """
    rows = len(word)
    can = [exits is None or any(exits[t] < NEVER for t in ((s,) if s < 2 else ()) + ((1,) if s == 0 else ()) + (2, 3)) for s in STATES]
    price = [0 if can[s] else NEVER for _ in range(rows + 1) for s in STATES]
    final = [not can[s] for _ in range(rows + 1) for s in STATES]
    if exits is not None:
        price[4 * rows :] = exits
        final[4 * rows :] = [True] * 4

    def best(node: int) -> tuple[int, int]:
        row, state = divmod(node, 4)
        offers = [(cost + price[4 * r + s], 4 * r + s) for _, cost, r, s in arcs(word, row, state)]
        if exits is None and row == rows and state in ENDS:
            offers.append((0, -1))
        return min(offers)

    for row in range(rows, -1, -1):
        for state in STATES:
            path = [4 * row + state]
            while path[-1] >= 0 and not final[path[-1]]:
                offer, to = best(path[-1])
                if price[path[-1]] == offer:
                    path.append(to)
                else:
                    price[path[-1]] = offer
                    if len(path) > 1:
                        path.pop()
            for node in path:
                if node >= 0:
                    final[node] = True
    return tuple(price)


@lru_cache(200_000)
def traced(word: str, exits: tuple[int, ...] | None, state: int) -> tuple[str, int]:
    """(edits, state at the end of the block): along tight arcs, the least letter first."""
    price, row, out = auctioned(word, exits), 0, []
    while not (row == len(word) and (exits is not None or state in ENDS)):
        edit, _, row, state = next(a for a in arcs(word, row, state) if a[1] + price[4 * a[2] + a[3]] == price[4 * row + state])
        out.append(edit)
    return "".join(out), state


def table(word: str, last: bool) -> list[int]:
    """The least cost from each state at the start of a block to each at its end; of the last block, to the end."""
    if last:
        return list(auctioned(word, None)[:4])
    ways = [auctioned(word, tuple(0 if t == leave else NEVER for t in STATES)) for leave in STATES]
    return [min(ways[leave][enter], NEVER) for enter in STATES for leave in STATES]


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the registered query, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, role, text = F.crc32(name) % 20, F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.when(kind == 4, "user").otherwise(role)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.array_repeat(F.lit(0), copies).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def _rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, mark): without nulls but of the turn; the mark orders rows of one turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("mark", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _judged(rows: DataFrame) -> DataFrame:
    """Without texts: the place of each row, its first fault, and whether it may follow the row before."""
    end = F.substring(F.rtrim(F.col("text"), F.lit(_SPACES)), -1, 1)
    light = rows.select("conv_id", "turn", "mark", F.substring("role", 1, 1).alias("initial"), end.alias("end"))
    first_byte = F.conv(F.hex(F.substring("mark", 1, 1)), 16, 10).cast("long")
    block = F.coalesce(F.shiftright("turn", 12), F.lit(-(1 << 60)) + first_byte)
    before = {"initial_before": F.col("initial"), "turn_before": F.col("turn")}
    light = settled(ordered(light, ["conv_id"], ["turn", "mark"], block, position="pos", total="total", previous=before), "repair-rows")
    firsts = light.groupBy("conv_id", "mark").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("first"))
    blank, again, cut = F.col("end") == "", F.col("first").isNull(), ~F.col("end").isin(".", "!", "?")
    plain = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(blank | again, "x").when(cut, F.upper(plain)).otherwise(plain)
    pair = F.concat("initial_before", "initial")
    return light.join(firsts, ["conv_id", "pos"], "left").select(
        "conv_id",
        "pos",
        "total",
        "turn",
        letter.alias("letter"),
        blank.cast("long").alias("blank"),
        (~blank & again).cast("long").alias("duplicate"),
        (~blank & ~again & cut).cast("long").alias("truncated"),
        ((F.col("pos") > 0) & ~pair.isin("su", "ua", "au")).cast("long").alias("illegal"),
        F.when(F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn_before") != F.col("turn"))), 1).otherwise(0).alias("new_turn"),
    )


def _blocks(judged: DataFrame) -> DataFrame:
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "new_turn")]
    by = judged.groupBy("conv_id", F.expr(f"pos DIV {BLOCK}").alias("block"))
    found = by.agg(word.alias("word"), F.max("total").alias("total"), *sums, F.min("turn").alias("least"), F.max("turn").alias("most"))
    return found.withColumn("last", F.col("block") == F.expr(f"(total - 1) DIV {BLOCK}"))


def _exits(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, exits) of all blocks but the last of a conversation: prices at the end of the block."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs = [table(w, last) for w, last in zip(b.column("word").to_pylist(), b.column("last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "block", "costs"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, price = None, [0] * 4
        for b in batches:
            ids, places, exits = [], [], []
            for conv, block, costs in zip(b.column("conv_id").to_pylist(), b.column("block").to_pylist(), b.column("costs").to_pylist(), strict=True):
                if conv != now:
                    now, price = conv, costs
                    continue
                ids.append(conv)
                places.append(block)
                exits.append(price)
                price = [min(min(costs[4 * s + t] + price[t] for t in STATES), NEVER) for s in STATES]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(exits, pa.list_(pa.int64()))], ["conv_id", "block", "exits"])

    long = blocks.where(F.col("total") > BLOCK).select("conv_id", "block", "word", "last")
    costs = long.mapInArrow(tables, "conv_id long, block long, costs array<long>")
    return costs.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc()).mapInArrow(chained, "conv_id long, block long, exits array<long>")


def _traces(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, cost, edits, leaves): for each state at the start of a block the cost to the end, its edits, the state at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost, edits, leaves = [], [], []
            for word, exits in zip(b.column("word").to_pylist(), b.column("exits").to_pylist(), strict=True):
                exits = tuple(exits) if exits is not None else None
                price = auctioned(word, exits)[:4]
                ways = [traced(word, exits, s) if price[s] < NEVER else ("", -1) for s in STATES]
                cost.append(price[0])
                edits.append([w for w, _ in ways])
                leaves.append([s for _, s in ways])
            columns = [b.column("conv_id"), b.column("block"), pa.array(cost, pa.int64()), pa.array(edits, pa.list_(pa.string())), pa.array(leaves, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "cost", "edits", "leaves"])

    priced = blocks.select("conv_id", "block", "word").join(_exits(blocks), ["conv_id", "block"], "left")
    return priced.mapInArrow(run, "conv_id long, block long, cost long, edits array<string>, leaves array<long>")


_REPAIRED = ["conv_id", "at", "cost", "edit", "role", "text"]


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's blocks, then its rows in order. Gives a row with at = -1, the cost and all edits, then the repaired rows."""
    now, cost, edits, at, row, state, n = None, 0, "", 0, 0, 0, 0
    pieces: list[str] = []
    out: list[tuple] = []

    def begun() -> None:
        nonlocal edits, pieces, state
        if pieces:
            edits, pieces, state = "".join(pieces), [], 0
            out.append((now, -1, cost, edits, None, None))

    def inserted() -> None:
        nonlocal at, n, state
        while at < len(edits) and edits[at] == "I":
            state = NEXT[state]
            out.append((now, n, None, "I", "user" if state == 2 else "assistant", ""))
            n, at = n + 1, at + 1

    def shaped() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _REPAIRED)
        out.clear()
        return batch

    for b in batches:
        for conv, of_block, new_cost, ways, leaves, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "block", "cost", "edits", "leaves", "role", "text")], strict=True):
            if conv != now:
                begun()
                inserted()
                now, at, n, state = conv, 0, 0, 0
            if of_block is not None:
                cost = new_cost if of_block == 0 else cost
                pieces.append(ways[state])
                state = leaves[state]
                continue
            begun()
            inserted()
            edit, at = edits[at], at + 1
            if edit == "D":
                continue
            state = kept(role[:1], state) if edit == "K" else NEXT[state]
            out.append((now, n, None, edit, role if edit == "K" else ("user" if state == 2 else "assistant"), text))
            n += 1
        yield shaped()
    begun()
    inserted()
    yield shaped()


def _edited(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    moves = _traces(blocks).withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = moves.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "block", "turn", "mark")
    return dealt.select("conv_id", "block", "cost", "edits", "leaves", "role", "text").mapInArrow(_applied, "conv_id long, at long, cost long, edit string, role string, text string")


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, edit, role, text): the turns of every conversation after its cheapest repair, at from 0.

    The roles' initials then read (s?(ua)+)?. A row without a word and one whose role and
    text were there before go; others are kept, reroled or deleted, and turns without text inserted.
    Order, nulls, ties and other odd rows: see ``repair_report``.
    """
    ship_package(conversations.sparkSession)
    rows = _rows(conversations)
    return _edited(rows, settled(_blocks(_judged(rows)), "repair-blocks")).where("at >= 0").select("conv_id", "at", "edit", "role", "text")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, state, n = None, hashlib.sha256(), 0
    for b in batches:
        done = []
        for conv, at, cost, edit, role, text in zip(*[b.column(c).to_pylist() for c in _REPAIRED], strict=True):
            if at < 0:
                if head:
                    done.append((*head, state.hexdigest()))
                head, state = (conv, cost, edit), hashlib.sha256()
            else:
                state.update(f"{chr(10) if at else ''}{role}:{text}".encode())
        if done:
            yield _reports(done)
    if head:
        yield _reports([(*head, state.hexdigest())])


def _reports(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "cost", "audit", "repaired_sha256"])


def repair_report(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: faults found, the cheapest repair, and a digest of the repaired turns.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    ``ids`` (conv_id) names conversations that are to have a row even without rows.
    Rows are taken by turn, null first, and inside a turn by a digest of role and text; equal
    rows are duplicates. A null role or text is one space; a row whose role is empty or begins
    with another letter than s, u or a can't be kept. Rows without a conv_id belong to none
    and are left out. Very long texts are read once, by digest and last letter, and streamed into
    the digest; a conversation of any number of rows is repaired in blocks. Without rows: zeros,
    an empty audit, the digest of nothing. An empty table gives an empty result; other columns aren't read.
    """
    ship_package(conversations.sparkSession)
    rows = _rows(conversations)
    blocks = settled(_blocks(_judged(rows)), "repair-blocks")
    span = F.max("most") - F.min("least") + 1 - F.sum("new_turn")
    counts = blocks.groupBy("conv_id").agg(span.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    edits = _edited(rows, blocks).mapInArrow(_digested, "conv_id long, cost long, audit string, repaired_sha256 string")
    named = (conversations if ids is None else ids).where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return named.join(counts, "conv_id", "left").join(edits, "conv_id", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(damaged(conversations), conversations)


def _cheapest(state: int) -> str:
    """For DuckDB: of a row's edits from a state without inserting before it, the least (cost, edits); w holds what follows."""
    way = lambda cost, letter, to: f"{{'c': {cost} + w[{to + 1}].c, 's': '{letter}' || w[{to + 1}].s}}"
    keeps = " ".join(f"WHEN gone = 0 AND initial = '{i}' THEN {way('cut', 'K', to)}" for i in "sua" if (to := kept(i, state)) is not None)
    rerole = f"CASE WHEN gone = 0 THEN {way(f'{REROLE} + cut', 'R', NEXT[state])} END"
    return f"list_min(list_filter([{way(DELETE, 'D', state)}, {f'CASE {keeps} END' if keeps else 'NULL'}, {rerole}], lambda z: z IS NOT NULL))"


def _with_inserts(state: int) -> str:
    one, two = NEXT[state], NEXT[NEXT[state]]
    more = lambda to, n: f"{{'c': {INSERT * n} + x[{to + 1}].c, 's': '{'I' * n}' || x[{to + 1}].s}}"
    return f"list_min([x[{state + 1}], {more(one, 1)}, {more(two, 2)}])"


OP13_SQL = f"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  conv_id::VARCHAR || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations WHERE conv_id IS NOT NULL),
hit AS (SELECT *, {CRC32.format("name")} % 20 AS f FROM named),
a AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(range(0, CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)),
m AS (SELECT *, md5(length(role) || ':' || role || text) AS mark, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail, left(role, 1) AS initial FROM a),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS i FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, mark ORDER BY i) AS seen FROM z),
r AS (SELECT *, (tail = '')::INT AS blank, (tail <> '' AND seen > 1)::INT AS duplicate, (tail <> '' AND seen = 1 AND tail NOT IN ('.', '!', '?'))::INT AS cut,
  (tail = '' OR seen > 1)::INT AS gone, (i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'))::INT AS illegal FROM o),
n AS (SELECT conv_id, max(i) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank) AS blank, sum(duplicate) AS duplicate,
  sum(cut) AS truncated, sum(illegal) AS illegal FROM r GROUP BY conv_id),
v(conv_id, i, w) AS (SELECT conv_id, rows, [{{'c': 0, 's': ''}}, {{'c': {2 * INSERT}, 's': 'II'}}, {{'c': {INSERT}, 's': 'I'}}, {{'c': 0, 's': ''}}] FROM n
  UNION ALL SELECT conv_id, i, [{", ".join(map(_with_inserts, STATES))}]
  FROM (SELECT v.conv_id, v.i - 1 AS i, [{", ".join(map(_cheapest, STATES))}] AS x FROM v JOIN r ON r.conv_id = v.conv_id AND r.i = v.i)),
best AS (SELECT conv_id, w[1].c AS cost, w[1].s AS audit FROM v WHERE i = 0),
e AS (SELECT conv_id, j, substr(audit, j, 1) AS edit, length(replace(audit, 'D', '')) % 2 AS odd FROM best, unnest(range(1, length(audit) + 1)) u(j)),
p AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS k FROM e),
t AS (SELECT p.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
  FROM p LEFT JOIN r ON r.conv_id = p.conv_id AND r.i = p.i WHERE edit <> 'D' GROUP BY p.conv_id)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM named) d LEFT JOIN n ON n.conv_id = d.conv_id LEFT JOIN best ON best.conv_id = d.conv_id LEFT JOIN t ON t.conv_id = d.conv_id"""
