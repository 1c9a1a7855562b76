"""Byte-level BPE as a streaming transducer, and the state machine that turns ids back into text.

Encoding. A merge list in which every operand is made before it is used runs in the order of
its ranks. Compare a text with one of its prefixes, ending at byte e: the two runs can only
differ where a chain of merges carries the difference leftwards, each merge of a higher rank
than the one before, its right part starting with the left part of the one before. The
longest such chain, in bytes, is the sufficient lookahead: tokens that end at or before
e - lookahead are the same in both. They are emitted, and the rest waits for more bytes,
so a piece of any length takes constant memory.

Decoding. Ids become bytes through a table, bytes become text through a UTF-8 machine that
keeps at most three pending bytes; bad sequences become U+FFFD as the library has it.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lexspan.llm.common import id_and_text, slices
from lexspan.llm.units import PLAIN, PLAIN_PIECES, Memory, led, units

#: The split before the merges: a published constant of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes beyond the lookahead that the transducer takes in before it emits.
STEP = 1024
NO_MERGE = 1 << 40
#: Ids that the decoder takes at a time.
CHUNK = 65_536


#: Whether a text is one piece of plain letters.
_LETTERS = regex.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary file: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def letters_of_bytes() -> dict[int, str]:
    """For str.translate, from bytes read as Latin-1."""
    return {b: c for c, b in byte_letters().items()}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right that can still change a token; the merges come in the order of their ranks."""
    left = {}
    for u, v in merges:
        if u + v in left or any(len(x) > 1 and x not in left for x in (u, v)):
            raise ValueError("a merge list must make each token once, and before it is used")
        left[u + v] = u
    reach: dict[bytes, int] = {}  # by the left part of a merge so far: the longest chain that ends with such a merge
    for u, v in merges:
        x, most = v, 0
        while x is not None:
            most, x = max(most, reach.get(x, 0)), left.get(x)
        reach[u] = max(reach.get(u, 0), len(u) + most)
    return max(reach.values(), default=0)


class Transducer:
    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.lookahead = sufficient_lookahead([(as_bytes(a), as_bytes(b)) for a, b in merges])
        self.rank: dict[int, dict[int, int]] = {i: {} for i in ids.values()}  # by left token, by right token
        for rank, (a, b) in enumerate(merges):
            self.rank[ids[a]][ids[b]] = rank
        self.made = [ids[a + b] for a, b in merges]
        self.byte = [0] * 256
        for c, b in letters.items():
            self.byte[b] = ids[c]
        # the same for bytes as they come: all pairs, so that none is missing
        self.first = {(a, b): self.rank[self.byte[a]].get(self.byte[b], NO_MERGE) for a in range(256) for b in range(256)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: as_bytes(t) for t, i in ids.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.find = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # as bytes: the garbage collector walks over lists again and again, over bytes never
        self.pieces = Memory(lambda x: array("I", self.piece(x)).tobytes(), 150_000)

    def merged(self, raw: bytes) -> list[int]:
        """The tokens of bytes that are taken as a whole: the lowest rank first, from the left."""
        out, rank, made = list(map(self.byte.__getitem__, raw)), self.rank, self.made
        ranks = list(map(self.first.__getitem__, zip(raw, raw[1:])))  # noqa: B905
        ranks.append(NO_MERGE)  # of the last token
        while (lowest := min(ranks)) < NO_MERGE:
            at = ranks.index(lowest)
            out[at] = token = made[lowest]
            del out[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank[out[at - 1]].get(token, NO_MERGE)
            if at + 1 < len(out):
                ranks[at] = rank[token].get(out[at + 1], NO_MERGE)
        return out

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece as soon as they are stable; holds lookahead + STEP bytes and a chunk at most."""
        held = b""
        for chunk in chunks:
            held += chunk
            while len(held) >= self.lookahead + STEP:
                window, end = held[: self.lookahead + STEP], 0
                for t in self.merged(window):
                    if end + len(self.bytes_of[t]) > STEP:
                        break
                    end += len(self.bytes_of[t])
                    yield t
                held = held[end:]
        yield from self.merged(held)

    def piece(self, text: str) -> list[int]:
        raw = text.encode()
        if len(raw) < self.lookahead:
            return self.merged(raw)
        return list(self.stream(raw[i : i + STEP] for i in range(0, len(raw), STEP)))

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def packed(self, text: str) -> bytes:
        """Its ids, four bytes each."""
        out: list[bytes] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out += map(self.pieces.__getitem__, self.find(part))
        return b"".join(out)

    def packed_spaced(self, word: str) -> bytes:
        """Of a word and what leads it; where the pieces are plain to see, the slower pattern isn't needed."""
        if _LETTERS(word):
            return self.pieces[" " + word]
        lead, body = led(word)
        if not PLAIN.fullmatch(body) or "<|" in body:
            return self.packed(lead + body)
        first, *rest = PLAIN_PIECES.findall(body)
        led_by = ["\n", first] if lead == "\n" else [" " + first]
        return b"".join(map(self.pieces.__getitem__, led_by + rest))


class Decoder:
    """Ids in, text out, in steps: what isn't yet a whole character waits."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.machine = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


@cache
def _of(vocabulary: str) -> tuple[Transducer, Memory, Memory, list[str]]:
    """One transducer in each Python worker, with its memories of units as they are and after a space, kept over tasks; and the ids in decimals."""
    t = Transducer(vocabulary)
    decimals = [str(i) for i in range(1 + max(t.bytes_of))]
    return t, Memory(t.packed, 20_000), Memory(t.packed_spaced, 250_000), decimals


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids and decoded.

    Ids are those of the tokenizers library without added special tokens, truncation and padding;
    a special token's string in a text becomes that token. ids_sha256 is over the decimal ids
    joined by commas, decoded_sha256 over the decoded text. Null text counts as empty: no ids.
    Null ids, repeated rows and ties: each row is encoded by itself. An empty table gives an
    empty result; other columns aren't read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, as_it_is, after_space, decimals = _of(vocabulary)
        for part in slices(batches):
            n, coded, text, all_ids, decoded = [], [], [], [], []
            for whole in part.column("text").to_pylist():
                some, words = units(whole) if whole else ([], [])
                ids = array("I", b"".join([*map(as_it_is.__getitem__, some), *map(after_space.__getitem__, words)]))
                coded.append(hashlib.sha256(",".join(map(decimals.__getitem__, ids)).encode()).hexdigest())
                machine, plain, kept = Decoder(transducer.bytes_of), hashlib.sha256(), []
                for at in range(0, max(1, len(ids)), CHUNK):
                    out = machine.feed(ids[at : at + CHUNK], at + CHUNK >= len(ids))
                    plain.update(out.encode())
                    if with_ids:
                        kept.append(out)
                n.append(len(ids))
                text.append(plain.hexdigest())
                if with_ids:
                    all_ids.append(list(ids))
                    decoded.append("".join(kept))
            out = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out, names = [*out, pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    more = ", ids array<int>, decoded string" if with_ids else ""
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
