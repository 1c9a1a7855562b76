"""Merge-type sentencepiece encoding by backtracking, and the machine that turns ids back into text.

Merging takes the pair of the highest score first, from the left. Two facts make its result a
path that can be searched from the left: in the tokens of a text each two neighbours, merged
anew by themselves, come out as they are; and only one sequence of tokens has this
property. So the search takes the longest token at a place (Aho-Corasick over the pieces),
goes to shorter ones while a token doesn't stand beside the one before, and steps back where
none does. A place from which no way leads
on is set in a bitfield and never tried again, so the search ends after linear work.

No text is encoded by the library: it lists the pieces and normalises.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lexspan.llm.common import id_and_text, slices
from lexspan.llm.units import Memory

#: What stands for a space in pieces.
SPACE = "▁"
#: Ids that the decoder takes at a time.
CHUNK = 65_536

#: sentencepiece has one U+FFFD for each byte that isn't part of a character.
codecs.register_error("lexspan-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """The encoder of one model: pieces, their scores, the automaton, and what was found out about pairs."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        every = range(model.get_piece_size())
        self.normalize = model.normalize
        names = {i: model.id_to_piece(i) for i in every}
        own = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.byte = {int(names[i][1:-1], 16): i for i in every if model.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the model needs a piece for each byte")
        if any(model.is_unused(i) for i in own):
            raise ValueError("models with unused pieces aren't read")
        self.ids = {names[i]: i for i in own}
        self.score = {names[i]: model.get_score(i) for i in own}
        self.bytes_of = [b""] * len(every)
        for i in every:
            if model.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.bytes_of[i] = names[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.leads, self.squeezes = model.normalize("a").startswith(SPACE), model.normalize("a  b").count(SPACE) == model.normalize("a b").count(SPACE)
        self.starts_with_space = {i for s, i in self.ids.items() if s.startswith(SPACE)}
        self.digits = [str(i) for i in every]
        self.automaton = ahocorasick.Automaton()
        for s in self.score:
            self.automaton.add_word(s, s)
        self.automaton.make_automaton()
        self.neighbours = {pair for s in self.score for pair in zip(s, s[1:], strict=False)}
        # cuts that no piece reaches across: before a space that follows anything else, around a letter that no piece holds
        if any(SPACE in s.lstrip(SPACE) for s in self.score):
            raise ValueError("a piece holds a space after other letters: texts can't be cut at words")
        self.line = "\n" if not any("\n" in s for s in self.score) else ""
        self.cut = regex.compile(rf"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+" if self.line else rf"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.stands = Memory(lambda pair: self.merged("".join(pair)) == list(pair), 300_000)
        self.shorter: dict[str, str | None] = {}

    def merged(self, text: str) -> list[str]:
        """The definition: of all neighbours whose union is a piece, the best score first, from the left."""
        out, score, none = list(text), self.score, float("-inf")
        worth = [score.get(a + b, none) for a, b in zip(out, out[1:], strict=False)]
        while worth and (best := max(worth)) > none:
            at = worth.index(best)
            out[at : at + 2] = [out[at] + out[at + 1]]
            del worth[at]
            if at:
                worth[at - 1] = score.get(out[at - 1] + out[at], none)
            if at < len(worth):
                worth[at] = score.get(out[at] + out[at + 1], none)
        return out

    def next_shorter(self, token: str) -> str | None:
        """The longest proper prefix that is a piece, or a single letter."""
        if token not in self.shorter:
            fits = (token[:k] for k in range(len(token) - 1, 0, -1) if k == 1 or token[:k] in self.score)
            self.shorter[token] = next(fits, None)
        return self.shorter[token]

    def longest(self, text: str, at: int) -> str:
        """The longest piece that begins here, or the letter."""
        for end, token in self.automaton.iter_long(text, at):
            if end + 1 - len(token) == at:
                return token
            break
        return text[at]

    def tokens(self, text: str) -> list[str]:
        """The pieces of a normalised text; a letter without a piece is a token of its own."""
        n, stands, next_shorter = len(text), self.stands, self.next_shorter
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        at = 0
        while at < n:
            token: str | None = self.longest(text, at)
            while True:
                while token is not None:
                    end = at + len(token)
                    if not failed[end >> 3] >> (end & 7) & 1 and stands[(out[-1], token) if out else (token,)]:
                        break
                    token = next_shorter(token)
                if token is not None:
                    out.append(token)
                    at = end
                    break
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()  # its end has failed, so it gives way to a shorter one
                at -= len(token)
        return out

    def encode_part(self, text: str) -> list[int]:
        out: list[int] = []
        for token in self.tokens(text):
            one = self.ids.get(token)
            if one is None:
                out += [self.byte[b] for b in token.encode()]
            else:
                out.append(one)
        return out

    def parts(self, text: str) -> list[str]:
        """A normalised text in pieces whose ids, one after another, are its ids."""
        if SPACE * 2 in text or SPACE + "\n" in text:
            return self.cut(text)
        first, *more = text.replace("\n", SPACE + "\n").split(SPACE) if self.line else text.split(SPACE)
        return [first, *[w if w[:1] == "\n" else SPACE + w for w in more]]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(self.normalize(text)) for piece in self.split(part) for i in self.encode_part(piece)]

    def split(self, part: str) -> list[str]:
        """A part, cut between letters that stand side by side in no piece: no merge reaches across."""
        if self.neighbours.issuperset(zip(part, part[1:], strict=False)):
            return [part]
        cuts = [i + 1 for i, pair in enumerate(zip(part, part[1:], strict=False)) if pair not in self.neighbours]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)]


class PieceDecoder:
    """Ids in, text out, in steps; the space that normalising put before the text goes."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.machine = pieces, codecs.getincrementaldecoder("utf-8")("lexspan-each-byte")
        self.begun = not (pieces.leads or pieces.squeezes)

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        bytes_of, ids, raw = self.pieces.bytes_of, iter(ids), b""
        while not self.begun and (i := next(ids, None)) is not None:
            raw = bytes_of[i]
            spaced = i in self.pieces.starts_with_space
            if spaced:
                raw = raw[1:]
            self.begun = bool(raw) or spaced and not self.pieces.squeezes
        return self.machine.decode(raw + b"".join(map(bytes_of.__getitem__, ids)), last)


class Known(Memory):
    """Ids of parts, as bytes: a part that isn't remembered is put together from smaller ones that may be."""

    def __init__(self, pieces: Pieces):
        super().__init__(self.found, 300_000)
        self.pieces = pieces

    def found(self, part: str) -> bytes:
        few = self.pieces.split(part)
        return b"".join([self[x] for x in few]) if len(few) > 1 else array("I", self.pieces.encode_part(part)).tobytes()


@cache
def _of(vocabulary: str) -> tuple[Pieces, Known]:
    """One encoder in each Python worker, with its memory of parts, kept over tasks."""
    p = Pieces(vocabulary)
    return p, Known(p)


def encode_decode_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids and decoded.

    Ids are those of the sentencepiece library without begin and end ids and without sampling;
    letters without a piece become bytes. ids_sha256 is over the decimal ids joined by commas,
    decoded_sha256 over the decoded text. Null text counts as empty: no ids. Very long texts
    are encoded whole, word by word; a word of any length takes memory in proportion to it.
    Null ids, repeated rows and ties: each row is encoded by itself. An empty table gives an empty
    result; other columns aren't read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = _of(vocabulary)
        digits = pieces.digits
        for part in slices(batches):
            n, coded, text, all_ids, decoded = [], [], [], [], []
            for whole in part.column("text").to_pylist():
                ids = array("I", b"".join(map(known.__getitem__, pieces.parts(pieces.normalize(whole))))) if whole else array("I")
                coded.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                machine, plain, kept = PieceDecoder(pieces), hashlib.sha256(), []
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


def op11_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
