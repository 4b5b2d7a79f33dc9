"""Cleaning chain (C1-C12): reference cases in our own words, the
adversarial strings, and the guard invariant."""
import pymodel
from pyspark.sql import functions as F

from riskscope.functions.text import clean, model_tokens, tokenize, ustrip

ADVERSARIAL = [
    "Mail foo@bar.com now", "a@-b.c tail", "x@ y", "@éx rest", "@a²b z", "日本foo@bar.com",
    "http://e.com/a#frag~x{y} z", "HTTPS://Ex.com/%41%zz?q=1;b w", "don’t don't", "KK ſ",
    "tab\there\nnew\x0bvt\x1cfs", "no @break", "t.co/http://a", "!@#$%^&*()", "", "   ",
    "a@b@c.d e", "u@.x.y z", "half½@½½x y", "http://😀x foo", "Check https://t.co/abc NOW!!", "@user hello",
    "I ❤️ this 😀 very much", "12 Monkeys and 7 dwarfs", "The Enemy's PLAN",
    "x a@b.c@d y", "@@a.b z", "a@.b c", "a@b. c", "foo@bar.com. end", "q a@b.c\u00a0d e", "a@b..c", "é@é.é x",
    "multi\n  a.b@c.d\tnext", "@a@b.c", "x@@y.z w", "line\u2028a@b.c", "a@-b.c. x", "q@-.x.y z", "m@-x.",
]


def _clean_all(spark, texts, guarded=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", clean("t", guarded).alias("c")).orderBy("i").collect()
    return [r["c"] for r in rows]


def test_matches_python_semantics(spark):
    got = _clean_all(spark, ADVERSARIAL)
    want = [pymodel.clean(t) for t in ADVERSARIAL]
    assert got == want


def test_guard_changes_nothing(spark):
    assert _clean_all(spark, ADVERSARIAL, True) == _clean_all(spark, ADVERSARIAL, False)


def test_reference_examples(spark):
    got = _clean_all(spark, ["Check https://example.com/page now", "hey @someone look", "Great 😀😃 day",
                             "UPPER Case", "Mail foo@bar.com now"])
    assert got == ["check now", "hey look", "great day", "upper case", "mail foo com now"]


def test_tokens_and_counts(spark):
    df = spark.createDataFrame([("",), ("   ",), ("!@#$%",), ("a b  c",)], "t string")
    out = df.select(tokenize(clean("t")).alias("k")).collect()
    assert [r["k"] for r in out] == [[], [], [], ["a", "b", "c"]]


def test_long_text_and_model_cut(spark):
    text = " ".join(["word"] * 10_000)
    df = spark.createDataFrame([(text,)], "t string").select(tokenize(clean("t")).alias("k"))
    r = df.select(F.size("k").alias("n"), F.size(model_tokens("k", 256)).alias("m")).first()
    assert (r["n"], r["m"]) == (10_000, 256)


def test_ustrip_unicode_whitespace(spark):
    df = spark.createDataFrame([(" \t hi there 　\n",), (" ",), ("x",)], "t string")
    assert [r[0] for r in df.select(ustrip("t")).collect()] == ["hi there", "", "x"]


def test_random_strings_match_python_model(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    pieces = st.sampled_from([
        "a", "Z", "é", "İ", "ß", "5", "½", "_", "'", "’", "@", ".", ":", "/", "-", "#", "~", "?", "=",
        " ", "  ", "\t", "\n", " ", " ", "　", "😀", "❤", "中", "http://", "https://", "HTTP://",
        "kill", "our", "people", "holy", "war", "x.y", "a@b", "@c.d", "www",
    ])
    texts = st.lists(st.lists(pieces, max_size=12).map("".join), min_size=300, max_size=300)

    @settings(max_examples=6, deadline=None)
    @given(texts)
    def check(batch):
        got = _clean_all(spark, batch)
        assert got == [pymodel.clean(t) for t in batch]

    check()
