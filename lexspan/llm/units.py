"""Cutting a text where no tokenizer rule reaches across, so that a unit's ids can be kept and reused."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import regex

#: Runs of white space around a space or line break: what they give depends on the whole run, so a cut at each would be wrong.
_RUN = regex.compile(r"[\s\x1c-\x1f][ \n]|\n[\s\x1c-\x1f]")
#: Entries of each generation of a worker's memory, and the longest text that is remembered.
REMEMBERED, LONGEST = 300_000, 48
#: Texts whose pieces are plain to see: printable ASCII but the apostrophe, and the letters of Latin-1 (composed, one case each).
PLAIN = regex.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
#: The pieces of such a text: letters, digits, others.
PLAIN_PIECES = regex.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[^A-Za-z0-9À-ÖØ-öø-ÿ]+")


def units(text: str) -> tuple[list[str], list[str]]:
    """Pieces whose ids, one after another, are the ids of the whole text: (units as they stand, words after a space).

    Each cut lies before a space or line break that follows a character that isn't white
    space. The pattern of the byte-level vocabularies starts a piece at such a place or
    looks no further back than it; the word vocabulary drops white space. A word that
    follows a line break instead of a space begins with it.
    """
    if _RUN.search(text) is None:
        words = text.replace("\n", " \n").split(" ")
        return [words.pop(0)], words
    out, start, at = [], 0, text.find(" ", 1)
    while at > 0:
        if not (text[at - 1].isspace() or "\x1c" <= text[at - 1] <= "\x1f"):
            out.append(text[start:at])
            start = at
        at = text.find(" ", at + 1)
    return [*out, text[start:]], []


def led(word: str) -> tuple[str, str]:
    """What stands before a word of units(), and the word."""
    return ("\n", word[1:]) if word.startswith("\n") else (" ", word)


class Memory(dict):
    """Results of a costly function of a short text. Two generations: when the younger is full, it becomes the older."""

    def __init__(self, compute: Callable[[str], Any], entries: int = REMEMBERED):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key: str) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONGEST:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
