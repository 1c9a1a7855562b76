import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [
    ("Disk Quota देखिए।", "disk quota देखिए"),
    ("४५६ slides", "456 slides"),
    ("  A,B--c d\n", "a b c d"),
    (None, ""),
])
def test_normalize(spark, raw, want):
    assert one(spark, raw, X.normalize) == want


def python_normalize(s):
    s = unicodedata.normalize("NFC", s).translate(str.maketrans(X.DEVANAGARI_DIGITS, X.ASCII_DIGITS)).lower()
    return " ".join("".join(" " if c in X.PUNCTUATION else c for c in s).split())


def test_normalize_agrees_with_python_on_many_strings(spark):
    samples = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.text(alphabet=st.one_of(
        st.characters(min_codepoint=32, max_codepoint=0x17F), st.characters(min_codepoint=0x900, max_codepoint=0x97F),
        st.sampled_from("\t\n  ́̈Åẛ̣क़")), max_size=40))
    def collect(s):
        if "İ" not in s and "\x00" not in s:
            samples.append(s)

    collect()
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select("t", X.normalize(F.col("t")).alias("n")).collect()
    assert [r for r in rows if r["n"] != python_normalize(r["t"])] == []


def test_script_mix(spark):
    assert one(spark, "यह disk quota देखेंगे", X.script_mix) == {"dev": 0.5, "lat": 0.5, "other": 0.0}
    assert one(spark, "", X.script_mix) == {"dev": 0.0, "lat": 0.0, "other": 0.0}
    assert one(spark, "12 प्रिंटer é", X.script_mix)["other"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("word,key", [
    ("screen", "skrn"), ("स्क्रीन", "skrn"), ("print", "prnt"), ("प्रिंट", "prnt"), ("paste", "pst"), ("पेस्ट", "pst"),
    ("a", "a"), ("y", "y"), ("123", ""), ("phone", "fn"), ("cell", "sl"), ("चे", "s"), ("quiz", "kj"),
])
def test_skeleton(spark, word, key):
    assert one(spark, word, X.skeleton) == key


def test_normalize_sa_makes_scripts_meet(spark):
    df = spark.createDataFrame([("screen print 12 a",), ("स्क्रीन प्रिंट १२ a",)], "t string").select(X.normalize(F.col("t")).alias("n"))
    out = [r["sa"] for r in X.with_normalized_sa(df, "n", "sa").collect()]
    assert out == ["skrn prnt a", "skrn prnt a"]
    kept = [r["sa"] for r in X.with_normalized_sa(df, "n", "sa", transliterate=False).collect()]
    assert kept[1] == "स्क्रीन प्रिंट a"


def test_prompts(spark):
    units = [f"unit {i} tells a short story" for i in range(12)]
    df = spark.createDataFrame([(units,), ([],), (["  ", None],), (None,)], "p array<string>")
    got = [r[0] for r in df.select(X.prose_prompt(F.col("p"), 60)).collect()]
    assert len(got[0].split()) == 60 and got[0].endswith(units[-1]) and got[0].index("unit 5") < got[0].index("unit 6")
    assert got[1:] == [X.GENERIC_PROMPT] * 3
    kw = spark.createDataFrame([([["a", "b"], ["b", "c d"]],)], "k array<array<string>>")
    assert kw.select(X.keyword_prompt(F.col("k"))).first()[0] == "a, b, c d"


def test_retrieval_conditions_need_units(spark):
    df = spark.createDataFrame([("C4", [["k"]], ["p"], [])], "c string, k array<array<string>>, p array<string>, r array<string>")
    with pytest.raises(Exception, match="needs retrieved units"):
        df.select(X.condition_prompt(F.col("c"), F.col("k"), F.col("p"), F.col("r"))).collect()


def test_custom_token_split(spark):
    chars = lambda c: F.split(c, "")
    assert one(spark, "abcdef", lambda c: X.token_count(c, chars)) == 6


def test_slug_and_stamp(spark):
    assert one(spark, "Operating Systems: 101!", X.slugify) == "operating-systems-101"
    assert one(spark, "समझ", X.slugify) == "unit"
    assert one(spark, None, X.slugify) == "unit"
    assert one(spark, "x" * 50, X.slugify) == "x" * 32
    assert spark.range(1).select(X.mmss(F.lit(3725.9))).first()[0] == "62:05"


def test_clean_pages(spark):
    df = spark.createDataFrame([(["a  b\n\n\n\n\nc", None, " "],), ([" ", None],)], "p array<string>")
    assert [tuple(r[0]) for r in df.select(X.clean_pages(F.col("p"))).collect()] == [("a b\n\nc", False), (None, False)]
    assert [tuple(r[0]) for r in df.select(X.clean_pages(F.col("p"), 3)).collect()] == [("a b", True), (None, False)]
    assert [tuple(r[0]) for r in df.select(X.clean_pages(F.col("p"), None)).collect()] == [("a b\n\nc", False), (None, False)]


MERGES = [(1, "t", "h"), (2, "th", "e"), (3, "i", "n"), (4, "a", "a"), (5, "in", "g"), (6, "aa", "aa"), (7, "e", "r"), (8, "the", "r")]


def subwords_by_hand(text):
    out = []
    for word in text.split():
        parts = list(word)
        for _, a, b in MERGES:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [a + b]
                i += 1
        out += [" " + parts[0], *parts[1:]]
    return out


def test_last_subwords_equal_cutting_the_whole(spark):
    """1,000 random texts: splitting only the last words gives the end of all subwords."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the", "ring", "aa", "a", "er", "x", "é", " ", "  ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df = df.withColumn("steps", X.merge_list(spark.createDataFrame(MERGES, "rank int, left string, right string")))
    for n in (1, 7):
        got = {r["i"]: r["k"] for r in df.select("i", X.keep_last_subwords(F.col("t"), n, X.merged_subwords(F.col("steps"))).alias("k")).collect()}
        for i, t in enumerate(texts):
            parts = subwords_by_hand(t)
            assert got[i] == (t if len(parts) <= n else "".join(parts[-n:]).lstrip(" ")), (n, t)


def test_tasks_grow_in_number_with_the_rows(spark, tmp_path):
    """A table of one file gave as many tasks at any size."""
    from lexspan.session import by_rows

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert by_rows(df, ["id"], 2).rdd.getNumPartitions() == 50
    assert by_rows(df, ["id"], 2).distinct().count() == 100
