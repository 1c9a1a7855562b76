"""Near-duplicate documents by an LSH forest over MinHash signatures.

A forest has several trees; a tree orders all sets by a run of their minima. Sorted that way, the
sets with the longest common prefix with a set stand next to it, so depth adapts to each
region: where few sets share a first minimum, that one is enough, and where a common passage
puts thousands together, their neighbours agree on more. The order is made by a range shuffle,
which cuts a large region anywhere; rows at the cuts are compared in a second, small step.

1. Sets of five-word shingles; equal sets become one node, so copies are counted, never paired.
2. In every tree each node takes the first node after it, within WINDOW places and the same first minimum,
   that a one-bit sketch of all minima doesn't rule out. Pairs of some trees are verified on full
   sets and joined to components. That is at most one pair per node and tree.
3. Nodes that met any other are sorted again, with their components and a longer sketch. Now all pairs
   within WINDOW places are taken that join different components, verified, and joined in turn.
4. A region is what shares the first REGION minima of a tree. Where it holds more than WINDOW nodes and still more
   than one component, its nodes outside the region's largest component are held against all of it, in blocks of
   fixed size: the likeliest partners are verified first, then all others that would still join two components.

So a large group is met by the few nodes that haven't joined it, never by its own square, and no number of
neighbours is a limit. Two sets linked at 0.75 exactly share no region in 2 of a million cases, fewer above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import MIX, id_and_text, released, row_key, scrambled, settled, shingles, slices, word_hashes, words
from lexspan.llm.components import components

SHINGLE = 5
#: A link needs 100 * intersection >= LINK * union.
LINK = 75
TREES, DEPTH = 24, 8
#: Trees whose pairs are verified in the first round, and places in an order that are looked at after each row.
FIRST, WINDOW = 6, 32
#: Minima that make a region, and rows on each side of a block when a crowded region is searched whole.
REGION, BLOCK = 3, 4096
#: A pair is ruled out below these estimates, from a bit of each minimum and from a byte of each: five standard deviations under 0.75.
LEAST_BY_BITS, LEAST_BY_BYTES = 0.5, 0.6
KEY, BIT_SKETCH, BYTE_SKETCH = 4 * DEPTH, TREES * DEPTH // 8, TREES * DEPTH
#: Bits of the map of documents whose sets are needed; 8 MiB, whatever their number.
BITS = 1 << 26


def minima(grams: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima; the grams are hashes already, so odd factors give as many orders."""
    factors = scrambled(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    return np.concatenate([(grams[None, :] * factors[i : i + 32, None]).min(axis=1) for i in range(0, len(factors), 32)])


def _sets_of(part: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray, bytes | None]]:
    """By document: id, distinct shingles in order, and their digest."""
    tokens = [words(t) for t in part.column("text").to_pylist()]
    hashed = word_hashes([w for t in tokens for w in t])
    at = 0
    for name, t in zip(part.column("doc_id").to_pylist(), tokens, strict=True):
        grams = np.unique(shingles(hashed[at : at + len(t)], SHINGLE))
        at += len(t)
        yield name, grams, hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def signatures(texts: DataFrame) -> DataFrame:
    """By document: doc_id, row (its key), n_shingles, digest of its set (null if empty), keys (the minima, tree by tree), bits and bytes (sketches, one of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: dict[str, list] = {"doc_id": [], "row": part.column("row"), "n_shingles": [], "digest": [], "keys": [], "bits": [], "bytes": []}
            for name, grams, digest in _sets_of(part):
                low = minima(grams) if digest else None
                out["doc_id"].append(name)
                out["n_shingles"].append(len(grams))
                out["digest"].append(digest)
                out["keys"].append((low >> np.uint64(32)).astype(">u4").tobytes() if digest else None)
                mixed = scrambled(low) if digest else None
                out["bits"].append(np.packbits(mixed & np.uint64(1) == 1).tobytes() if digest else None)
                out["bytes"].append((mixed >> np.uint64(56)).astype(np.uint8).tobytes() if digest else None)
            types = {"doc_id": pa.int64(), "n_shingles": pa.int64()}
            yield pa.RecordBatch.from_pydict({k: v if k == "row" else pa.array(v, types.get(k, pa.binary())) for k, v in out.items()})

    return texts.mapInArrow(run, "doc_id long, row long, n_shingles long, digest binary, keys binary, bits binary, bytes binary")


_ROW = pa.schema([("tree", pa.int32()), ("key", pa.binary()), ("digest", pa.binary()), ("sketch", pa.binary()), ("label", pa.binary())])
_FOUND = pa.schema([("a", pa.binary()), ("b", pa.binary()), *_ROW, ("gap", pa.int32()), ("after", pa.bool_()), ("region", pa.int64())])
FOUND = "a binary, b binary, tree int, key binary, digest binary, sketch binary, label binary, gap int, after boolean, region long"


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(-1, width // np.dtype(kind).itemsize)


def region_of(tree: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Names of regions: a hash of the tree and its first REGION minima."""
    out = tree.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(REGION):
            out = scrambled(out * MIX + first[..., at].astype(np.uint64))
    return out.view(np.int64)


def full_regions(rows: pa.Table, new_from: int) -> np.ndarray:
    """Regions with more than WINDOW rows, seen by a row and the one WINDOW places after it (from place new_from on)."""
    if rows.num_rows <= WINDOW:
        return np.zeros(0, np.int64)
    names = region_of(rows["tree"].to_numpy(), _matrix(rows["key"], KEY, ">u4")[:, :REGION])
    return np.unique(names[:-WINDOW][(names[:-WINDOW] == names[WINDOW:]) & (np.arange(WINDOW, len(names)) >= new_from)])


def pairs_within(rows: pa.Table, new_from: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of rows close in the order that may be linked; only those with j >= new_from.

    every: all such pairs of different labels, but inside a region that is seen to be full only the first of each i: such regions
    are searched whole later. Otherwise for each i its first j of all.
    """
    n = rows.num_rows
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tree, first = rows["tree"].to_numpy(), _matrix(rows["key"], KEY, ">u4")[:, 0]
    label = _matrix(rows["label"], 16, "<u8")
    sketch = _matrix(rows["sketch"], BYTE_SKETCH, "u1") if every else _matrix(rows["sketch"], BIT_SKETCH, "<u8")

    def may_be(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if every:
            return (sketch[i] == sketch[j]).sum(axis=1) >= LEAST_BY_BYTES * BYTE_SKETCH
        return np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= (1 - LEAST_BY_BITS) / 2 * 8 * BIT_SKETCH

    taken, out_i, out_j = np.zeros(n, bool), [], []
    if every:
        names, full = region_of(tree, _matrix(rows["key"], KEY, ">u4")[:, :REGION]), np.zeros(n, bool)
        if n > WINDOW:
            seen = names[:-WINDOW] == names[WINDOW:]
            full[:-WINDOW] |= seen
            full[WINDOW:] |= seen
    for s in range(1, min(WINDOW, n - 1) + 1):
        near = (tree[:-s] == tree[s:]) & (first[:-s] == first[s:])
        if every:
            near &= (label[:-s] != label[s:]).any(axis=1) & ~(taken[:-s] & full[:-s] & (names[:-s] == names[s:]))
        else:
            near &= ~taken[:-s]
        i = np.flatnonzero(near)
        if not len(i) and not every and s > 1 and not ((tree[:-s] == tree[s:]) & (first[:-s] == first[s:])).any():
            break
        i = i[may_be(i, i + s)]
        taken[i] = True
        i = i[i + s >= new_from]
        out_i.append(i)
        out_j.append(i + s)
    return np.concatenate(out_i), np.concatenate(out_j)


def _pair_batch(rows: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Pairs with the lesser digest first; tree is the tree they met in."""
    digest = rows["digest"].to_pylist()
    ends = [sorted((digest[x], digest[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    blank = {f.name: pa.nulls(len(ends), f.type) for f in _FOUND}
    blank |= {"a": pa.array([x for x, _ in ends], pa.binary()), "b": pa.array([y for _, y in ends], pa.binary()), "tree": rows["tree"].take(pa.array(i)).combine_chunks()}
    return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in blank.values()], schema=_FOUND)


def met(rows: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b, tree) that are close in some tree of ``rows`` (digest, keys, sketch, label); the sketch is the bytes with ``every``, else the bits.

    Without ``every`` also rows (region) without a pair, for regions with more than WINDOW rows.
    """

    def named(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found) if f.name == "region" else pa.nulls(len(found), f.type) for f in _FOUND], schema=_FOUND)

    def edge(rows: pa.Table, gap: int, after: bool) -> list[pa.RecordBatch]:
        n = rows.num_rows
        more = {"a": pa.nulls(n, pa.binary()), "b": pa.nulls(n, pa.binary()), "gap": pa.array([gap] * n, pa.int32()), "after": pa.array([after] * n), "region": pa.nulls(n, pa.int64())}
        columns = [more[f.name] if f.name in more else rows[f.name] for f in _FOUND]
        return pa.Table.from_arrays(columns, schema=_FOUND).combine_chunks().to_batches()

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, head, heads = TaskContext.get().partitionId(), _ROW.empty_table(), [], 0
        for batch in batches:
            part = pa.Table.from_batches([batch]).cast(_ROW)
            if heads < WINDOW:
                head.append(part.slice(0, WINDOW - heads))
                heads += head[-1].num_rows
            both = pa.concat_tables([held, part]).combine_chunks()
            i, j = pairs_within(both, held.num_rows, every)
            if len(i):
                yield _pair_batch(both, i, j)
            full = full_regions(both, held.num_rows) if not every else ()
            if len(full):
                yield named(full)
            held = both.slice(max(0, both.num_rows - WINDOW))
        if heads:
            yield from edge(pa.concat_tables(head), at - 1, True)
            yield from edge(held, at, False)

    def across(table: pa.Table) -> pa.Table:
        """Rows of two neighbouring partitions: the last of one, the first of the next."""
        table = table.sort_by([("after", "ascending"), ("tree", "ascending"), ("key", "ascending"), ("digest", "ascending")]).combine_chunks()
        before = table.num_rows - int(np.sum(table["after"].to_numpy()))
        i, j = pairs_within(table, before, every)
        keep = i < before
        full = full_regions(table, before) if not every else np.zeros(0, np.int64)
        return pa.Table.from_batches([_pair_batch(table, i[keep], j[keep]), named(full)]).select(["a", "b", "tree", "region"])

    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    spread = rows.select("digest", "keys", "sketch", "label", tree)
    spread = spread.select("tree", F.expr(f"substring(keys, tree * {KEY} + 1, {KEY})").alias("key"), "digest", "sketch", "label")
    order = ["tree", "key", "digest"]
    found = settled(spread.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(inside, FOUND), "forest")
    cut = found.where("gap IS NOT NULL").groupBy("gap").applyInArrow(across, "a binary, b binary, tree int, region long")
    return found.where("gap IS NULL").select("a", "b", "tree", "region").union(cut)


def bitmap_of(marks: DataFrame) -> np.ndarray:
    """BITS bits, those of ``marks`` (bit) set; at most BITS / 64 rows come to the driver."""
    marks = marks.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[marks["at"].to_numpy()] = marks["bits"].to_numpy().view(np.uint64)
    return out


def _marked(part: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    at = part.column("bit").to_numpy()
    return part.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0))


def among(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``nodes`` joined with ``wanted`` (digest, no duplicates, and more); a map of bits leaves out nearly all others before anything is shuffled."""
    bit = F.pmod(F.xxhash64("digest"), F.lit(BITS)).alias("bit")
    held = nodes.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(bit)))
    rows = nodes.select("*", bit)
    return rows.mapInArrow(lambda batches: (_marked(part, held.value) for part in batches), rows.schema).drop("bit").join(wanted, "digest")


def sets_of(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest and grams, the full set, of each node in ``wanted`` (digest, no duplicates). Only texts that stand for such a node are read into sets."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    held = texts.sparkSession.sparkContext.broadcast(bitmap_of(nodes.join(wanted, "digest").select(bit.alias("bit"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            part = _marked(part, held.value)
            if part.num_rows:
                sets = [(d, g.view(np.int64)) for _, g, d in _sets_of(part) if d]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in sets], pa.binary()), pa.array([g for _, g in sets], pa.list_(pa.int64()))], ["digest", "grams"])

    found = texts.withColumn("bit", bit).mapInArrow(run, "digest binary, grams array<long>")
    return settled(found.join(wanted, "digest", "left_semi").dropDuplicates(["digest"]), "sets")


def verified(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are linked."""
    pairs = settled(pairs.select("a", "b").distinct(), "pairs")
    sets = sets_of(texts, nodes, pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct())
    of_a, of_b = sets.select(F.col("digest").alias("a"), F.col("grams").alias("x")), sets.select(F.col("digest").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("n"))
    linked = settled(both.where(f"100L * n >= {LINK}L * (nx + ny - n)").select("a", "b"), "linked")
    released(sets)
    return linked


def linked_sets(table: pa.Table) -> pa.Table:
    """Links (a, b) between asking rows and other rows of one block, by full sets: of each asking row one to each label but its own."""
    asks, digest = table["asks"].to_numpy(), table["digest"].to_pylist()
    label = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)[1]
    sizes = np.asarray(pc.list_value_length(table["grams"])).astype(np.int64)
    ends = np.cumsum(sizes)
    grams = np.concatenate([np.asarray(c.flatten()) for c in table["grams"].chunks])
    asking, other = np.flatnonzero(asks), np.flatnonzero(~asks)
    of = np.repeat(np.arange(len(sizes)), sizes)
    held = ~asks[of]
    order = np.argsort(grams[held], kind="stable")
    values, owners = grams[held][order], of[held][order]
    a, b = [], []
    for i in asking.tolist():
        own = grams[ends[i] - sizes[i] : ends[i]]
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        many = high - low
        at = np.repeat(high - np.cumsum(many), many) + np.arange(many.sum())
        shared = np.bincount(owners[at], minlength=len(sizes))[other]
        found = other[(100 * shared >= LINK * (sizes[i] + sizes[other] - shared)) & (label[other] != label[i])]
        for j in found[np.unique(label[found], return_index=True)[1]].tolist():
            a.append(min(digest[i], digest[j]))
            b.append(max(digest[i], digest[j]))
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def across_crowds(texts: DataFrame, nodes: DataFrame, labels: DataFrame, bitmap: Broadcast) -> DataFrame:
    """Links (a, b) of different labels in regions too full for WINDOW, found on full sets.

    ``nodes``: digest, doc_id, keys, bits, bytes; ``labels``: node, label; ``bitmap``: marks of the full regions. Each row that isn't
    of its region's most frequent label meets all rows of the region. A pair counts in the first full region that both are in.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            first = _matrix(part.column("keys"), KEY * TREES, ">u4").reshape(-1, TREES, DEPTH)[:, :, :REGION]
            names = region_of(np.broadcast_to(np.arange(TREES), first.shape[:2]), first).ravel()
            bit = names & (BITS - 1)
            full = (bitmap.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
            at = np.flatnonzero(full)
            of = pa.array(at // TREES)
            full_names = pa.array([x.tobytes() for x in np.where(full, names, 0).reshape(-1, TREES)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), part.column("digest").take(of), full_names.take(of)], ["region", "digest", "regions"])

    found = nodes.select("digest", "keys").mapInArrow(spread, "region long, digest binary, regions binary")
    members = settled(found.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest")), "crowds")
    sizes = members.groupBy("region", "label").agg(F.count("*").alias("n")).groupBy("region")
    sizes = sizes.agg(F.max_by("label", "n").alias("main"), F.ceil(F.sum("n") / BLOCK).alias("wide"), F.ceil((F.sum("n") - F.max("n")) / BLOCK).alias("high")).where("high > 0")
    rows = settled(members.join(sizes, "region"), "crowds")
    released(members)
    rows = among(nodes.select("digest", "bits", "bytes"), rows.select("digest").distinct()).join(rows, "digest")
    place = F.xxhash64("digest")
    met_by = F.transform(F.sequence(F.lit(0).cast("long"), F.col("high") - 1), lambda q: F.struct(q.alias("q"), F.pmod(place, F.col("wide")).alias("t"), F.lit(False).alias("asks")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1), lambda t: F.struct(F.pmod(place, F.col("high")).alias("q"), t.alias("t"), F.lit(True).alias("asks")))
    rows = rows.select("region", "digest", "label", "regions", "bits", "bytes", F.explode(F.when(F.col("label") == F.col("main"), met_by).otherwise(F.concat(met_by, meets))).alias("in"))

    def held_against(table: pa.Table) -> pa.Table:
        """The asking rows of one block that another row is likely linked to, and these others, by blocks of 64 asking rows."""
        asks, region = table["asks"].to_numpy(), table["region"][0].as_py()
        label, regions = _matrix(table["label"], 16, "<u8"), _matrix(table["regions"], 8 * TREES, "<i8")
        bits, sketch = _matrix(table["bits"], BIT_SKETCH, "<u8"), _matrix(table["bytes"], BYTE_SKETCH, "u1")
        asking, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        taken = np.zeros(len(asks), bool)
        for at in range(0, len(asking), 64):
            ask = asking[at : at + 64]
            apart = sum(np.bitwise_count(bits[ask, w][:, None] ^ bits[other, w][None, :]).astype(np.int16) for w in range(bits.shape[1]))
            x, y = np.nonzero(apart <= (1 - LEAST_BY_BITS) / 2 * 8 * BIT_SKETCH)
            x, y = ask[x], other[y]
            unlike = (label[x] != label[y]).any(axis=1)
            x, y = x[unlike], y[unlike]
            for i in range(0, len(x), BLOCK):
                p, q = x[i : i + BLOCK], y[i : i + BLOCK]
                likely = (sketch[p] == sketch[q]).sum(axis=1) >= LEAST_BY_BYTES * BYTE_SKETCH
                p, q = p[likely], q[likely]
                both = (regions[p] == regions[q]) & (regions[p] != 0)
                here = regions[p, both.argmax(axis=1)] == region
                taken[p[here]] = taken[q[here]] = True
        return table.select(["region", "t", "q", "digest", "label", "asks"]).filter(pa.array(taken))

    kinds = "region long, t long, q long, digest binary, label binary, asks boolean"
    likely = settled(rows.select("region", "in.*", "digest", "label", "regions", "bits", "bytes").groupBy("region", "t", "q").applyInArrow(held_against, kinds), "across")
    sets = sets_of(texts, nodes, likely.select("digest").distinct())
    links = settled(likely.join(sets, "digest").groupBy("region", "t", "q").applyInArrow(linked_sets, "a binary, b binary").distinct(), "linked")
    released(sets)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable, its own included), kept (doc_id is component_id).

    A set holds the distinct five-word shingles of the words, A-Z lower-cased; fewer words make one
    shingle. Sets with 100 * intersection >= 75 * union are linked. Null or empty text: no shingles,
    linked with nothing, kept. Null ids: never the least while another id is there; a component of only null ids
    has a null one, and all of it is kept. Rows that share an id are rows of their own with that id; of
    equal rows all are kept or none. An empty table gives an empty result; other columns aren't read.
    """
    rows, whole = _labelled(docs, id_col, text_col)
    least = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_set = whole.join(least, "label").select("digest", "component_id")
    out = rows.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row: the keys (``row_key``) of the rows to keep, one of each component: the least id, null ids last, then the least key. Texts without words are kept."""
    rows, whole = _labelled(docs, id_col, text_col)
    return whole.groupBy("label").agg(F.min("least").alias("least")).select("least.row").union(rows.where("digest IS NULL").select("row"))


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signatures of rows; and by different set its least row, that row's id and the label of its component."""
    texts = id_and_text(docs, id_col, text_col).withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    rows = settled(signatures(texts), "signatures")
    least = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row")).alias("least")
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(least, F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("bytes").alias("bytes"))
    nodes = settled(nodes.withColumn("doc_id", F.col("least.doc_id")), "nodes")
    found = settled(met(nodes.select("digest", "keys", F.col("bits").alias("sketch"), F.col("digest").alias("label")), every=False), "pairs")
    pairs, regions = found.where("region IS NULL").select("a", "b", "tree"), found.where("region IS NOT NULL")
    first = verified(texts, nodes, pairs.where(F.col("tree") < FIRST))
    labels = components(first)
    touched = settled(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct(), "touched")
    again = among(nodes.select("digest", "keys", "bytes"), touched).join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    second = verified(texts, nodes, met(again.select("digest", "keys", F.col("bytes").alias("sketch"), "label"), every=True).select("a", "b"))
    links = first.union(second)
    labels = components(links)
    full = bitmap_of(regions.select(F.expr(f"region & {BITS - 1}").alias("bit")))
    if full.any():
        bitmap = texts.sparkSession.sparkContext.broadcast(full)
        more = across_crowds(texts, nodes, labels, bitmap)
        if not more.isEmpty():
            labels = components(links.union(more))
    return rows, nodes.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "doc_id", "least", F.coalesce("label", "digest").alias("label"))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
