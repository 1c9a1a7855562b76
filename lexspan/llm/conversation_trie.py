"""All prefixes of all conversations, counted together by ROLLUP.

A conversation becomes rows of eight positions (a block), each with the id of its turn. One
``GROUP BY block, prior node, ROLLUP (eight ids)`` over the blocks of all conversations gives
every node: the grouping_id tells how many turns of the block a node covers. A long conversation
goes on in further rows; their key is the node that the block before ended in, written as
four running sums of hashes of (position, turn id), so no block waits for another and no pass
is needed for each block. A second ROLLUP over the nodes sums up subtrees; what lies in later
blocks is first summed by block and carried upwards by pointer doubling, in as many rounds as
the logarithm of the most blocks of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import settled
from lexspan.operators.ordered import ordered
from lexspan.session import ship_package

#: Positions of a block, the columns of the ROLLUP.
WIDTH = 8
IDS = [f"p{j}" for j in range(WIDTH)]
PRIOR = [f"a{i}" for i in range(4)]
KEY = ["depth", *(f"s{i}" for i in range(4))]
UP = ["up_depth", *(f"u{i}" for i in range(4))]
#: Conversation ids that are joined to one string before the strings of a node are hashed in order.
CHUNK_BITS = 12
#: The rebuilding of the registered query: a conversation takes its first turns from the first one of its five.
FAMILY, MOST_SHARED = 5, 9


def marked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, turn_id): the id is 128 bits of role and text, with the text's bytes beside them."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.struct(mark.alias("mark"), F.octet_length(text).alias("bytes")).alias("turn_id"))


def placed(turns: DataFrame) -> DataFrame:
    """Adds pos from 0 and total, by turn (null first), then by the turn's id; a huge conversation is numbered in blocks."""
    first_byte = F.conv(F.hex(F.substring(F.col("turn_id.mark"), 1, 1)), 16, 10).cast("long")
    block = F.coalesce(F.shiftright("turn", 12), F.lit(-(1 << 60)) + first_byte)
    return ordered(turns, ["conv_id"], ["turn", "turn_id"], block, position="pos", total="total").select("conv_id", "pos", "total", "turn_id")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id) of conversations whose first h turns come from the family's first conversation.

    h is the unsigned crc32 of the decimal conv_id modulo 9. The family's first is
    conv_id - conv_id % 5; it gives fewer turns where it has fewer, none where it is absent.
    """
    of_id = lambda c: F.crc32(c.cast("string")) % MOST_SHARED
    own = F.col("conv_id") % FAMILY == 0
    late = turns.withColumn("h", of_id(F.col("conv_id"))).where(own | (F.col("pos") >= F.col("h")))
    heads = turns.where(own & (F.col("pos") < MOST_SHARED - 1)).select(F.col("conv_id").alias("base"), "pos", "turn_id", "total")
    members = turns.select("conv_id").distinct().where(~own)
    asks = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), of_id(F.col("conv_id")).alias("h"))
    taken = asks.join(heads, "base").where("pos < h").select("conv_id", "pos", "turn_id")
    lacks = asks.join(heads.where("pos = 0"), "base", "left").select("conv_id", F.greatest(F.lit(0), F.col("h") - F.coalesce("total", F.lit(0))).alias("lacks")).where("lacks > 0")
    moved = late.join(lacks, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("lacks", F.lit(0))).alias("pos"), "turn_id")
    return moved.unionByName(taken)


def _pieces(turn_id: Column, pos: Column) -> list[Column]:
    """Four numbers of 32 bits; their sums over a prefix name it, in any order of summing and without overflow."""
    mark = turn_id["mark"]
    out = []
    for h in (F.xxhash64(pos.cast("long"), mark), F.xxhash64(mark, pos.cast("long"), F.lit("other"))):
        out += [h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)]
    return [F.when(turn_id.isNotNull(), c).otherwise(0) for c in out]


def _sums() -> list[Column]:
    """The four sums over the ids of a row."""
    each = [_pieces(F.col(p), F.col("block") * WIDTH + j) for j, p in enumerate(IDS)]
    return [sum((x[i] for x in each), F.lit(0).cast("long")) for i in range(4)]


def _blocks(members: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each eight turns of a conversation, and one for a conversation without turns, with the sums before it."""
    rows = turns.select("conv_id", F.expr(f"pos DIV {WIDTH}").alias("block"), (F.col("pos") % WIDTH).alias("at"), "turn_id")
    rows = rows.unionByName(members.select("conv_id", F.lit(0).cast("long").alias("block")), allowMissingColumns=True)
    wide = rows.groupBy("conv_id", "block").agg(*[F.max(F.when(F.col("at") == j, F.col("turn_id"))).alias(p) for j, p in enumerate(IDS)])
    own = {f"own{i}": c for i, c in enumerate(_sums())}
    wide = wide.select("*", *[c.alias(n) for n, c in own.items()])
    summed = ordered(wide, ["conv_id"], ["block"], F.shiftright("block", 12), total="blocks", running={f"upto{i}": F.col(n) for i, n in enumerate(own)})
    return summed.select("conv_id", "block", "blocks", *IDS, *[(F.col(f"upto{i}") - F.col(f"own{i}")).alias(a) for i, a in enumerate(PRIOR)])


def _keys(depth: Column) -> list[Column]:
    return [depth.alias(KEY[0]), *[(F.col(a) + c).alias(k) for a, c, k in zip(PRIOR, _sums(), KEY[1:], strict=True)]]


def _rolled(df: DataFrame, aggregates: str) -> DataFrame:
    """Aggregates of every prefix of a block: ROLLUP, without the groups that end behind a conversation's last turn."""
    by = ", ".join(["block", *PRIOR])
    rolled = df.sparkSession.sql(f"SELECT {by}, {', '.join(IDS)}, {WIDTH} - bit_count(grouping_id()) AS level, {aggregates} FROM {{rows}} GROUP BY {by}, ROLLUP({', '.join(IDS)})", rows=df)
    rolled = rolled.withColumn("last", F.element_at(F.array(*IDS), F.when(F.col("level") > 0, F.col("level"))))
    return rolled.where((F.col("level") == 0) & (F.col("block") == 0) | F.col("last").isNotNull())


def digest_in_order(df: DataFrame, keys: list[str], order: str, text: str, joint: str = ",") -> DataFrame:
    """(keys, sha256) of the texts of each key in order, with ``joint`` between them; a task holds one text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for key, value in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), batch.column(text).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(joint.encode())
                state.update(value.encode())
            if done:
                yield shaped(done)
        if now is not None:
            yield shaped([(*now, state.hexdigest())])

    def shaped(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], [*keys, "digest"])

    ship_package(df.sparkSession)
    dealt = df.select(*[F.col(k).cast("long").alias(k) for k in keys], order, text).repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", digest string")


def _ends(blocks: DataFrame) -> DataFrame:
    """(key, digest) of the conversations that end at a node, ids ascending."""
    filled = sum((F.col(p).isNotNull().cast("long") for p in IDS), F.lit(0).cast("long"))
    last = blocks.where(F.col("block") == F.col("blocks") - 1).select(*_keys(F.col("block") * WIDTH + filled), "conv_id")
    chunks = last.groupBy(*KEY, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    return digest_in_order(chunks.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ",")), KEY, "chunk", "ids")


def _later_blocks(nodes: DataFrame) -> DataFrame:
    """(key, leaves, saved) of all that lies behind a node at the end of a block; empty where no conversation is that long."""
    behind = nodes.where("block > 0").groupBy((F.col("block") * WIDTH).alias("depth"), *[F.col(a).alias(k) for a, k in zip(PRIOR, KEY[1:], strict=True)])
    totals = settled(behind.agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved")), "trie-blocks")
    above = nodes.where(f"level = {WIDTH} AND block > 0").select(*KEY, (F.col("block") * WIDTH).alias(UP[0]), *[F.col(a).alias(u) for a, u in zip(PRIOR, UP[1:], strict=True)])
    links = settled(totals.join(above, KEY).select(*KEY, *UP), "trie-links")
    while not links.isEmpty():
        raised = totals.join(links, KEY).select(*[F.col(u).alias(k) for u, k in zip(UP, KEY, strict=True)], "leaves", "saved")
        more = totals.unionByName(raised).groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        further = links.select(*[F.col(k).alias(u) for k, u in zip(KEY, UP, strict=True)], *[F.col(u).alias(f"far_{u}") for u in UP])
        twice = links.join(further, UP).select(*KEY, *[F.col(f"far_{u}").alias(u) for u in UP])
        totals, links = settled(more, "trie-blocks"), settled(twice, "trie-links")
    return totals


def trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, pos, turn_id) of ``members`` (conv_id, each once)."""
    blocks = settled(_blocks(members, turns), "trie-rows")
    found = _rolled(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs")
    found = found.select("*", *_keys(F.col("block") * WIDTH + F.col("level")), F.coalesce(F.col("last.bytes"), F.lit(0)).cast("long").alias("bytes"))
    parent = [(F.col("depth") - 1).alias(UP[0]), *[(F.col(k) - c).alias(u) for k, c, u in zip(KEY[1:], _pieces(F.col("last"), F.col("depth") - 1), UP[1:], strict=True)]]
    found = settled(found.select(*KEY, *parent, "block", *PRIOR, *IDS, "level", "conv_id", "n_convs", "bytes"), "trie-found")
    kept = [c for c in found.columns if c not in KEY]
    rows = found.select(*KEY, F.struct(*kept).alias("node"))
    rows = rows.unionByName(found.where("depth > 0").select(*[F.col(u).alias(k) for u, k in zip(UP, KEY, strict=True)], F.lit(1).alias("child")), allowMissingColumns=True)
    rows = rows.unionByName(_ends(blocks), allowMissingColumns=True)
    met = rows.groupBy(*KEY).agg(F.first("node", ignorenulls=True).alias("node"), F.count("child").alias("n_children"), F.first("digest", ignorenulls=True).alias("digest"))
    leaf, own = (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("node.n_convs") - 1) * F.col("node.bytes")).alias("own")
    nodes = settled(met.select(*KEY, "node.*", "n_children", leaf, own, F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")), "trie-nodes")

    carried = nodes.where(f"level = {WIDTH}").join(_later_blocks(nodes), KEY).select("block", *PRIOR, *IDS, F.col("leaves").alias("leaf"), F.col("saved").alias("own"))
    summed = _rolled(nodes.select("block", *PRIOR, *IDS, "leaf", "own").unionByName(carried), "sum(leaf) AS n_leaves, sum(own) AS saved_tokens")
    summed = summed.select(*_keys(F.col("block") * WIDTH + F.col("level")), "n_leaves", "saved_tokens")
    parents = nodes.where("n_children > 0").select(*[F.col(k).alias(u) for k, u in zip(KEY, UP, strict=True)], F.col("conv_id").alias("parent_conv_id"))
    full = nodes.select(*KEY, *UP, "conv_id", "n_convs", "n_children", "ends_sha256").join(summed, KEY).join(parents, UP, "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of turns (role, text), the empty one included.

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree: members but one, times the bytes of the last text) and
    ends_sha256 (over the ids of the conversations that end here). Turns are ordered by turn,
    null first; turns of one number by a digest of role and text. A null role or text is empty; rows
    without a conv_id belong to no conversation and are left out. Repeated rows are turns of their
    own. Texts of any length count by digest and bytes. An empty table gives no node; other columns
    aren't read.
    """
    turns = settled(placed(marked_turns(conversations)), "trie-turns")
    return trie(turns.select("conv_id").distinct(), turns)


def rebuilt_prefix_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of the conversations that ``rebuilt`` makes; one that is left without turns is a member of the root."""
    turns = settled(placed(marked_turns(conversations)), "trie-turns")
    return trie(turns.select("conv_id").distinct(), rebuilt(turns))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The unsigned crc32 of an ASCII string, for DuckDB.
CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)), lambda acc, b: "
    "list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"
)

OP12_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS mark, strlen(text) AS bytes, turn FROM t),
p AS (SELECT conv_id, mark, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) - 1 AS pos FROM o),
c AS (SELECT conv_id, {CRC32.format("conv_id::VARCHAR")} % {MOST_SHARED} AS h, conv_id - conv_id % {FAMILY} AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, mark, bytes FROM c JOIN p ON p.conv_id = base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, mark, bytes FROM c JOIN p ON p.conv_id = c.conv_id AND pos >= h),
s AS (SELECT conv_id, mark, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM r),
l AS (SELECT c.conv_id, coalesce(list(mark ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS marks, coalesce(list(bytes ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS sizes
  FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id),
m AS (SELECT conv_id, d, array_to_string(marks[1 : d], '') AS path, len(marks) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS bytes
  FROM l, unnest(range(0, len(marks) + 1)) u(d)),
g AS (SELECT path, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY path),
k AS (SELECT g.conv_id, g.depth, up.conv_id AS parent_conv_id FROM g LEFT JOIN g up ON up.depth = g.depth - 1 AND up.path = left(g.path, 32 * up.depth::INT)),
n AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL),
x AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN n ON n.conv_id = g.conv_id AND n.depth = g.depth),
y AS (SELECT a.path, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum(x.own) AS saved_tokens
  FROM x JOIN m a ON a.conv_id = x.conv_id AND a.d <= x.depth GROUP BY a.path)
SELECT x.conv_id, x.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM x JOIN y ON y.path = x.path JOIN k ON k.conv_id = x.conv_id AND k.depth = x.depth"""
