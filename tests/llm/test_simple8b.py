import random
import zlib

import numpy as np
import pytest

from lexspan.llm.simple8b import GROUP, pack, read_block, read_group, unpack, write_block


def cases():
    rng = np.random.default_rng(5)
    yield np.zeros(0, np.uint64)
    yield np.zeros(1000, np.uint64)
    yield np.ones(61, np.uint64)
    yield rng.integers(0, 49_408, 20_000).astype(np.uint64)
    yield np.array([2**64 - 1, 0, 2**60, 2**60 - 1, 1, 2**63], np.uint64)
    yield np.full(5000, 2**61, np.uint64)
    for _ in range(30):
        yield np.array([random.getrandbits(random.choice([0, 1, 2, 5, 8, 12, 16, 20, 31, 60, 61, 64])) for _ in range(random.randint(1, 4000))], np.uint64)


@pytest.mark.parametrize("values", list(cases()), ids=lambda v: str(len(v)))
def test_round_trip(values):
    words, _ = pack(values)
    assert (unpack(words, len(values)) == values).all()
    block = write_block([7, None], [len(values), 0], values)
    names, sizes, ids = read_block(block)
    assert names == [7, None] and sizes.tolist() == [len(values), 0] and (ids == values).all()
    for g in range(-(-len(words) // GROUP)):
        start, part = read_group(block, g)
        assert (part == values[start : start + len(part)]).all()
    assert not len(words) or sum(len(read_group(block, g)[1]) for g in range(-(-len(words) // GROUP))) == len(values)


def test_dense_words():
    assert len(pack(np.zeros(240, np.uint64))[0]) == 1
    assert len(pack(np.ones(60, np.uint64))[0]) == 1
    assert len(pack(np.full(30, 3, np.uint64))[0]) == 1
    assert len(pack(np.full(3, 2**20 - 1, np.uint64))[0]) == 1
    with pytest.raises(ValueError):
        read_block(b"XXXX" + bytes(40))


def test_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lexspan.llm.token_files import read_token_files, write_token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "Äpfel über  Bäume\nÀ'S it's", "<|endoftext|> x 12 é ́a İ ΣΑΣ\x1c", "a\tb\r\n c " * 50, "word " * 30_000, "same", "same"]
    rows = [(9 - i, t, "x") for i, t in enumerate(texts)] + [(2, "again", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    write_token_files(df, path, str(tmp_path / "f"))
    got = [tuple(r) for r in read_token_files(spark, str(tmp_path / "f"), with_ids=True).orderBy("start").collect()]
    whole, start, want = Tokenizer.from_file(path), 0, []
    for name, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want
    write_token_files(df.limit(0), path, str(tmp_path / "none"))
    assert read_token_files(spark, str(tmp_path / "none")).collect() == []
