"""Backtracking over pieces against the library, and against plain merging."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from lexspan.llm.piece_backtrack import PieceDecoder, Pieces, encode_decode_pieces, op11_piece_backtracking

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "  ", " ", "\n", "\n\n", " \n", "\n ", "\t", "é", "漢", "梦", "́", "\U0001f600", "1", "23", "'s", "<s>", "</s>", "<unk>", "<0x41>", "▁", "ing", "$$", ".", "\r\n", "İ", "\x00", "\x85", "\xa0", "th", "e", "in"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH)


def test_random_texts(library, pieces):
    random.seed(11)
    for _ in range(3000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 30)))
        ids = library.encode(text)
        assert pieces.encode(text) == ids, text
        assert PieceDecoder(pieces).feed(ids, True) == library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "thein" * 1500, " " * 3000, "=-" * 1500, "".join(random.Random(1).choice("etaoinsh") for _ in range(20_000)), "漢字" * 2000], ids=range(7))
def test_long_words(library, pieces, text):
    assert pieces.encode(text) == library.encode(text)


def test_search_equals_merging_and_steps_back(pieces):
    """Over letters that share many pieces the longest token is often wrong."""
    rng, back = random.Random(7), 0
    for _ in range(4000):
        text = "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 14)))
        want = pieces.merged(text)
        assert pieces.tokens(text) == want
        first = max((text[:k] for k in range(1, len(text) + 1) if text[:k] in pieces.score), key=len)
        back += want[0] != first
    assert back > 50


def test_decoder_by_steps(library, pieces):
    random.seed(5)
    for _ in range(500):
        ids = [random.randrange(1, 32_000) if random.random() < 0.7 else random.randrange(3, 259) for _ in range(20)]
        machine = PieceDecoder(pieces)
        assert "".join(machine.feed([i]) for i in ids) + machine.feed([], True) == library.decode(ids)


def expected(library, rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for name, text in rows:
        ids = library.encode(text or "")
        out.append((name, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    return out


def test_edge_cases(edge, library):
    from .conftest import EDGE

    assert Counter(map(tuple, encode_decode_pieces(edge, PATH).collect())) == Counter(expected(library, EDGE))
    whole = {(r.doc_id, r.decoded) for r in encode_decode_pieces(edge, PATH, with_ids=True).collect()}
    assert whole == {(i, library.decode(library.encode(t or ""))) for i, t in EDGE}
    assert encode_decode_pieces(edge.limit(0), PATH).collect() == []


def test_query(spark, sf, documents, library):
    assert sorted(map(tuple, op11_piece_backtracking(spark, sf).collect())) == sorted(expected(library, documents))
