"""Text expressions: normalisation, scripts, consonant skeletons, prompts, slugs.

Functions take and return Columns, or add columns to a DataFrame where a step
should be computed once per row. All run inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Whitespace as Python's str.split sees it, written out so that the Java and
# RE2 regex engines agree with it.
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHITESPACE_CHARS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~।॥“”‘’—–…"
DEVANAGARI_DIGITS = "०१२३४५६७८९"
ASCII_DIGITS = "0123456789"
DEVANAGARI = r"[\x{900}-\x{97f}]"

# Consonant-skeleton rewrites, applied in this order.
DIGRAPHS = [
    ("ph", "f"), ("gh", "g"), ("kh", "k"), ("chh", "c"), ("ch", "c"), ("sh", "s"),
    ("th", "t"), ("dh", "d"), ("bh", "b"), ("jh", "j"), ("ck", "k"),
    ("ce", "se"), ("ci", "si"), ("cy", "si"),
    ("ee", "i"), ("oo", "u"), ("aa", "a"), ("ai", "e"), ("au", "o"),
]
# Single letters: c, q -> k; z -> j; w -> v; m -> n; y and the vowels vanish.
SKELETON_FROM, SKELETON_TO = "cqzwmyaeiou", "kkjvn"

# Romanisation of Devanagari, lower-cased, marks without a letter value left out.
SIGN_FOLD = {"ॉ": "ो", "ॅ": "े", "़": ""}
ROMAN_MULTI = {
    "ख": "kh", "घ": "gh", "च": "ch", "छ": "ch", "झ": "jh", "ठ": "th", "थ": "th",
    "ढ": "dh", "ध": "dh", "फ": "ph", "भ": "bh", "श": "sh", "ष": "sh",
    "ऋ": "rri", "ॠ": "rri", "ृ": "rri", "ॄ": "rri",
    "ऌ": "lli", "ॡ": "lli", "ॢ": "lli", "ॣ": "lli",
    "ऐ": "ai", "ै": "ai", "औ": "au", "ौ": "au",
}
ROMAN_SINGLE = {
    "क": "k", "ग": "g", "ङ": "n", "ज": "j", "ञ": "n", "ट": "t", "ड": "d", "ण": "n",
    "त": "t", "द": "d", "न": "n", "प": "p", "ब": "b", "म": "m", "य": "y", "र": "r",
    "ल": "l", "ळ": "l", "व": "v", "स": "s", "ह": "h",
    "अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ए": "e", "ओ": "o",
    "ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "े": "e", "ो": "o",
    "ॆ": "e", "ॊ": "o", "ं": "m", "ँ": "n", "ः": "h", "्": "",
}
GENERIC_PROMPT = (
    "यह एक technical tutorial है जिसमें Hindi और English दोनों "
    "का प्रयोग होता है। आइए अब आगे बढ़ते हैं।"
)
MAX_SYLLABUS_CHARS = 120_000
# ----------------------------------------------------------------------------

# Text that may change under NFC: combining marks (other than the Devanagari
# signs that never compose or reorder on their own) and the singletons or
# composition exclusions. Everything else is already composed.
_NFC_SUSPECT = (
    r"[\p{M}&&[^\x{900}-\x{93b}\x{93d}-\x{950}\x{955}-\x{957}\x{962}\x{963}]]"
    r"|[\x{340}\x{341}\x{374}\x{37e}\x{387}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}-\x{a5e}"
    r"\x{b5c}\x{b5d}\x{f43}-\x{fb9}\x{1100}-\x{11ff}\x{1f71}-\x{1fff}\x{2000}\x{2001}"
    r"\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{2adc}\x{f900}-\x{faff}\x{fb1d}-\x{fb4f}"
    r"\x{10000}-\x{10ffff}]"
)


def nfc(c: Column) -> Column:
    """Unicode composition. Spark has no function for it, but ships ICU, so the
    rare strings that could change are composed there, inside the JVM."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    # nothing below U+0300 changes: that quick test settles most strings
    return F.when(c.rlike(r"[^\x{0}-\x{2ff}]") & c.rlike(_NFC_SUSPECT), composed).otherwise(c)


def strip(c: Column) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.regexp_replace(c, rf"\A{WHITESPACE}+|{WHITESPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def tokens(c: Column) -> Column:
    """Whitespace words of any text; NULL and blank give an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WHITESPACE + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def normalize(c: Column, compose: bool = True) -> Column:
    """Compose, ASCII digits, lower case, punctuation to space, single spaces.

    ``compose=False`` is for text known to be composed, for instance when it was
    normalised on ingestion.
    """
    base = F.coalesce(c, F.lit(""))
    if compose:
        base = nfc(base)
    blank = PUNCTUATION + WHITESPACE_CHARS
    mapped = F.translate(F.lower(base), DEVANAGARI_DIGITS + blank, ASCII_DIGITS + " " * len(blank))
    return F.trim(F.regexp_replace(mapped, "  +", " "))


def norm_words(norm: Column) -> Column:
    """Words of an already normalised string."""
    return F.filter(F.split(norm, " "), lambda w: w != "")


def script_of(word: Column) -> Column:
    return (
        F.when(word.rlike(DEVANAGARI), "dev").when(word.rlike("[a-z]"), "lat").otherwise("other")
    )


def with_script_counts(df: DataFrame, text: Column, compose: bool = True, prefix: str = "") -> DataFrame:
    """Add the token counts total, dev, lat and other of a text."""
    staged = df.withColumn("__n", normalize(text, compose))
    counts = script_counts(F.col("__n"))
    p = prefix
    return staged.select("*", *[counts[k].alias(p + k) for k in ("total", "dev", "lat")]).withColumn(
        p + "other", F.col(p + "total") - F.col(p + "dev") - F.col(p + "lat")).drop("__n")


def script_counts(norm: Column) -> dict[str, Column]:
    """Token counts per script of a normalised string, by regex counting."""
    total = F.when(norm == "", 0).otherwise(F.regexp_count(norm, F.lit(" ")) + 1)
    dev = F.regexp_count(norm, F.lit(rf"[^ ]*{DEVANAGARI}[^ ]*"))
    lat = F.regexp_count(
        norm, F.lit(r"(?:^| )[^\x{900}-\x{97f} ]*[a-z][^\x{900}-\x{97f} ]*(?= |$)")
    )
    return {"total": total, "dev": dev, "lat": lat, "other": total - dev - lat}


def script_mix(norm: Column) -> Column:
    """Map of script class to share of tokens; zeros for an empty string."""
    n = script_counts(norm)
    share = lambda k: F.when(n["total"] > 0, n[k] / n["total"]).otherwise(F.lit(0.0))
    return F.create_map(
        F.lit("dev"), share("dev"), F.lit("lat"), share("lat"), F.lit("other"), share("other")
    )


def romanize(norm: Column) -> Column:
    """Devanagari to plain lower-case Latin; other characters pass unchanged."""
    folded = F.translate(norm, "".join(SIGN_FOLD), "".join(SIGN_FOLD.values()))
    # a consonant with no vowel sign or virama carries the inherent vowel
    out = F.regexp_replace(
        folded, r"([\x{915}-\x{939}])(?![\x{93e}-\x{94d}\x{962}\x{963}])", "$1अ"
    )
    for src, dst in ROMAN_MULTI.items():
        out = F.replace(out, F.lit(src), F.lit(dst))
    kept = {k: v for k, v in ROMAN_SINGLE.items() if v}
    gone = [k for k, v in ROMAN_SINGLE.items() if not v]
    return F.translate(out, "".join(kept) + "".join(gone), "".join(kept.values()))


def _letters(norm: Column, transliterate: bool) -> Column:
    # only Devanagari letters are respelt, so a text without any skips the rewrites
    latin = F.when(norm.rlike(DEVANAGARI), romanize(norm)).otherwise(norm) if transliterate else norm
    return F.regexp_replace(latin, "[^a-z ]", "")


def _consonants(letters: Column) -> Column:
    for src, dst in DIGRAPHS:
        letters = F.replace(letters, F.lit(src), F.lit(dst))
    return F.regexp_replace(F.translate(letters, SKELETON_FROM, SKELETON_TO), r"([a-z])\1+", "$1")


def _zip_keys(keys: Column, letters: Column, norm: Column | None) -> Column:
    keyed = F.zip_with(F.split(keys, " "), F.split(letters, " "), lambda k, w: F.when(k == "", F.substring(w, 1, 1)).otherwise(k))
    if norm is None:
        return keyed
    return F.zip_with(keyed, F.split(norm, " "), lambda k, w: F.when(w.rlike(DEVANAGARI), w).otherwise(k))


def skeleton(word: Column, transliterate: bool = True) -> Column:
    """Cross-script consonant skeleton of one normalised word."""
    letters = _letters(word, transliterate)
    key = _consonants(letters)
    key = F.when(key == "", F.substring(letters, 1, 1)).otherwise(key)
    return key if transliterate else F.when(word.rlike(DEVANAGARI), word).otherwise(key)


def with_skeletons(df: DataFrame, norm: str, out: str, transliterate: bool = True) -> DataFrame:
    """Skeletons of the words of a normalised column, empty ones dropped.

    The rewrites run over the whole string (they never cross a space) in compiled
    projections; only the last step walks the words, where a word that vanished
    falls back to its first letter. Without ``transliterate`` Devanagari words
    stay as they are.
    """
    staged = df.withColumn("__l", _letters(F.col(norm), transliterate)).withColumn("__k", _consonants(F.col("__l")))
    keys = _zip_keys(F.col("__k"), F.col("__l"), None if transliterate else F.col(norm))
    return staged.withColumn(out, F.filter(keys, lambda k: k != "")).drop("__l", "__k")


def with_normalized_sa(df: DataFrame, norm: str, out: str, transliterate: bool = True) -> DataFrame:
    """Script-agnostic form of a normalised column."""
    return with_skeletons(df, norm, "__sk", transliterate).withColumn(out, F.array_join("__sk", " ")).drop("__sk")


def keep_last_tokens(c: Column, n: int, split: Callable[[Column], Column] = tokens) -> Column:
    """Keep the end of a text: its last ``n`` tokens, or all of it when shorter.

    ``split`` turns the text into an array of tokens; the default counts words.
    """
    t = split(c)
    return F.when(F.size(t) <= n, c).otherwise(
        F.array_join(F.slice(t, F.greatest(F.size(t) - n + 1, F.lit(1)), n), " ")
    )


#: Stand around each subword while a word is merged, and before a word's first one: private letters that texts don't hold.
_OPEN, _SHUT, WORD_START = "\ue000", "\ue001", "▁"


def merge_list(merges: DataFrame) -> Column:
    """The merges of a table (rank, left, right) as one value: a bounded list, read once. Add it as a column, and give that to ``merged_subwords``."""
    steps = F.struct("rank", "left", "right")
    return merges.agg(F.transform(F.sort_array(F.collect_list(steps)), lambda m: F.struct(
        F.concat(F.lit(_OPEN), m["left"], F.lit(_SHUT + _OPEN), m["right"], F.lit(_SHUT)).alias("pair"),
        F.concat(F.lit(_OPEN), m["left"], m["right"], F.lit(_SHUT)).alias("whole"))).alias("steps")).scalar()


def merged_subwords(merges: Column) -> Callable[[Column], Column]:
    """A tokenizer of words: letters, then each merge of the list in its order, from the left; the first subword has a mark before it."""

    def subwords(word: Column) -> Column:
        letters = F.array_join(F.transform(F.split(word, ""), lambda x: F.concat(F.lit(_OPEN), x, F.lit(_SHUT))), "")
        done = F.aggregate(merges, letters, lambda text, m: F.replace(text, m["pair"], m["whole"]))
        parts = F.split(F.substr(done, F.lit(2), F.length(done) - 2), _SHUT + _OPEN)
        return F.transform(parts, lambda p, i: F.when(i == 0, F.concat(F.lit(WORD_START), p)).otherwise(p))

    return subwords


def keep_last_subwords(c: Column, n: int, subwords: Callable[[Column], Column]) -> Column:
    """Keep the end of a text: its last ``n`` subwords, or all of it when it has no more.

    Every word has a subword at least, so the last ``n`` lie in the last ``n`` words, and a word's subwords
    don't depend on others: only these words are split, whatever the length of the text. ``subwords`` turns a word into an array.
    """
    words = tokens(c)
    tail = F.flatten(F.transform(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), subwords))
    end = F.array_join(F.slice(tail, F.greatest(F.size(tail) - n + 1, F.lit(1)), n), "")
    return F.when((F.size(words) <= n) & (F.size(tail) <= n), c).otherwise(F.ltrim(F.replace(end, F.lit(WORD_START), F.lit(" "))))


def token_count(c: Column, split: Callable[[Column], Column] = tokens) -> Column:
    return F.size(split(c))


def prose_prompt(proses: Column, max_tokens: int = 200) -> Column:
    """Join the trimmed non-empty entries in the given order, keep the end."""
    parts = F.filter(F.transform(proses, strip), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, F.lit(GENERIC_PROMPT)).otherwise(
        keep_last_tokens(F.array_join(parts, " "), max_tokens)
    )


def keyword_prompt(keyword_lists: Column, max_tokens: int = 200) -> Column:
    """Order-preserving distinct keywords over all units, comma-separated."""
    return keep_last_tokens(F.array_join(F.array_distinct(F.flatten(keyword_lists)), ", "), max_tokens)


def condition_prompt(cond: Column, keywords: Column, all_prose: Column, retrieved: Column,
                     max_tokens: int = 200) -> Column:
    """Prompt of each experimental condition; C0 has none."""
    return (
        F.when(cond == "C0", F.lit(None).cast("string"))
        .when(cond == "C1", F.lit(GENERIC_PROMPT))
        .when(cond == "C2", keyword_prompt(keywords, max_tokens))
        .when(cond == "C3", prose_prompt(all_prose, max_tokens))
        .when(
            cond.isin("C4", "C5", "C6", "C7"),
            F.when(F.coalesce(F.size(retrieved), F.lit(0)) <= 0,
                   F.raise_error(F.concat(cond, F.lit(" needs retrieved units"))).cast("string"))
            .otherwise(prose_prompt(retrieved, max_tokens)),
        )
        .otherwise(F.raise_error(F.concat(F.lit("unknown condition "), cond)).cast("string"))
    )


def slugify(c: Column) -> Column:
    base = F.lower(F.when(F.coalesce(c, F.lit("")) == "", F.lit("unit")).otherwise(c))
    s = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 32), F.lit("")), F.lit("unit"))


def clean_pages(pages: Column, longest: int | None = MAX_SYLLABUS_CHARS) -> Column:
    """Join extracted pages, squeeze blanks; NULL text (reject) when nothing is left.

    A struct of ``text``, cut after ``longest`` characters (None: kept whole), and ``truncated``.
    """
    text = F.array_join(F.transform(pages, lambda p: F.coalesce(p, F.lit(""))), "\n\n")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")
    whole = F.nullif(strip(text), F.lit(""))
    if longest is None:
        return F.struct(whole.alias("text"), F.lit(False).alias("truncated"))
    return F.struct(F.substring(whole, 1, longest).alias("text"), F.coalesce(F.length(whole) > longest, F.lit(False)).alias("truncated"))


def mmss(seconds: Column) -> Column:
    s = F.coalesce(seconds, F.lit(0.0)).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
