"""Token counts and the BPE transducer against the library."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexspan.llm.token_counts import UnitCounts, op7_token_counts, token_counts
from lexspan.llm.transducer import Decoder, Transducer, encode_decode, op4_bpe_transducer, sufficient_lookahead
from lexspan.llm.units import Memory, units

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", "  ", " ", "\n", "\n\n", "\t", "é", "漢", "́", "\U0001f600", "1", "23", "'s", "'ll", "<|endoftext|>", "\x1c", "\x85", "\xa0", "ing", "$$", ".", "\r\n", "İ", "ß", "\x00", "ª"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def transducer():
    return Transducer(PATH)


def test_random_texts(library, transducer):
    random.seed(3)
    for _ in range(1500):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert transducer.encode(text) == ids
        some, spaced = units(text)
        assert [i for u in some for i in transducer.encode(u)] + [i for u in spaced for i in transducer.encode_spaced(u)] == ids


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, "thein" * 3000, " " * 3000, "=-" * 3000, "".join(random.Random(1).choice("etaoinsh") for _ in range(20_000))], ids=range(6))
def test_streams_long_pieces(library, transducer, text):
    raw = text.encode()
    got = list(transducer.stream(raw[i : i + 37] for i in range(0, len(raw), 37)))
    assert got == transducer.merged(raw)
    assert transducer.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_lookahead():
    assert sufficient_lookahead([]) == 0
    assert sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2  # a b|c: whether c follows decides about b, and so about a
    with pytest.raises(ValueError):
        sufficient_lookahead([(b"ab", b"c")])


def test_decoder_keeps_pending_bytes(library, transducer):
    random.seed(4)
    for _ in range(300):
        ids = [random.randrange(50_257) for _ in range(20)]
        machine = Decoder(transducer.bytes_of)
        assert "".join(machine.feed([i]) for i in ids) + machine.feed([], True) == library.decode(ids, skip_special_tokens=False)


def test_memory_keeps_two_generations():
    asked = []
    memory = Memory(lambda x: asked.append(x) or len(x), 3)
    for x in ["a", "b", "c", "d", "a", "y" * 100, "y" * 100]:
        assert memory[x] == len(x)
    assert asked == ["a", "b", "c", "d", "y" * 100, "y" * 100]


def test_batches_of_unseen_units(library):
    """Counts are the library's; a unit is asked for once, in a batch, unless it is long or the memory was full."""
    random.seed(6)
    calls = []
    encode = lambda batch: calls.append(batch) or [len(e) for e in library.encode_batch(batch, add_special_tokens=False)]
    for entries in (3, 1000):
        count = UnitCounts(encode, entries)
        for _ in range(40):
            texts = ["".join(random.choice(PARTS) for _ in range(random.randint(0, 30))) for _ in range(random.randint(0, 9))]
            assert count(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]
    count, calls[:] = UnitCounts(encode), []
    assert count(["the ing the", "", "ing the\nthe " + "z" * 400_000]) == count(["the ing the", "", "ing the\nthe " + "z" * 400_000])
    short, long, again = calls[0] + [u for c in calls[1:-1] for u in c], "z" * 400_000, calls[-1]
    assert len(short) == len(set(short)) and again == [" " + long]


def expected(library, rows):
    out = []
    for name, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((name, len((text or "").encode()), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return out


def test_edge_cases(edge, library):
    from .conftest import EDGE

    want = expected(library, EDGE)
    assert Counter(map(tuple, token_counts(edge, PATH).collect())) == Counter((i, b, n, n > 512) for i, b, n, _, _ in want)
    assert Counter(map(tuple, encode_decode(edge, PATH).collect())) == Counter((i, n, x, y) for i, _, n, x, y in want)
    whole = {(r.doc_id, r.decoded) for r in encode_decode(edge, PATH, with_ids=True).collect()}
    assert whole == {(i, t or "") for i, t in EDGE}
    assert token_counts(edge.limit(0), PATH).collect() == encode_decode(edge.limit(0), PATH).collect() == []


def test_other_vocabulary(edge):
    import sentencepiece

    from .conftest import EDGE

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert Counter((r[0], r[2]) for r in token_counts(edge, path).collect()) == Counter((i, len(model.encode(t or ""))) for i, t in EDGE)


def test_queries(spark, sf, documents, library):
    want = expected(library, documents)
    assert sorted(map(tuple, op7_token_counts(spark, sf).collect())) == sorted((i, b, n, n > 512) for i, b, n, _, _ in want)
    assert sorted(map(tuple, op4_bpe_transducer(spark, sf).collect())) == sorted((i, n, x, y) for i, _, n, x, y in want)


def test_remembered_pieces_cost_no_collections():
    """What the transducer remembers isn't walked over by Python's garbage collector, and ids stay those of the merges."""
    import gc

    import public_tokenizers

    from lexspan.llm.transducer import Transducer

    t = Transducer(public_tokenizers.path("byte_bpe_50k.json"))
    text = "The cat, naïve and 12 dogs' x<|endoftext|> über"
    assert t.encode(text) and b"".join(t.bytes_of[i] for i in t.encode(text)).decode() == text
    assert len(t.pieces) and not any(map(gc.is_tracked, t.pieces.values()))
