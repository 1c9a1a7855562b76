"""Words of the token files against the library, one by one."""

from tokenizers import Tokenizer


def test_words_as_the_library_has_them(monkeypatch):
    """A word of plain ASCII letters goes to the model as one piece, without the search for pieces."""
    import re

    import public_tokenizers

    from lexspan.llm import token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    asked = []

    class Pieces:
        def findall(self, text):
            asked.append(text)
            return re.findall("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+", text)

    monkeypatch.setattr(token_files, "_PIECES", Pieces())
    encode = token_files._encoder.__wrapped__(path)
    for text in ["The QUICK fox", "naïve Über x1y2, a.b", "don't  <|x|>\tİI", "ab12 CD", "…"]:
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)
    assert asked and not {"the", "quick", "fox", "cd"} & set(asked)
