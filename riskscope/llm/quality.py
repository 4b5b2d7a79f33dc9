"""Quality rules (operator 4): hashed n-gram log-likelihood ratio.

A document's tokens are its words, with runs of ASCII punctuation set apart.
Tokens and token pairs are hashed into ``BUCKETS`` buckets; a token that repeats
the one before makes the same pair whatever the token is.
Two multinomials over the buckets are estimated: the trusted target, from
documents labelled good, and the raw corpus, from all documents, scaled to the
target's size.  Both are smoothed alike, so an n-gram that the target is too
small to have seen says little.  A document's score is the sum of log(target / raw) over its n-grams, divided by their number; a document is kept if the score reaches ``THRESHOLD``.  Weights are
rounded to millionths, so sums are whole numbers and every document's verdict
is the same in any order of work.

Base rules come first: under 20 words, or over 30 % of the words in repeated
8-word windows, and a document is out whatever its score.

Only DataFrame functions are used.  What reaches the driver is the weight of
each bucket: a table of fixed size.  The trusted documents are the
``TARGET_ROWS`` labelled ones that come first by hash of the id (a documented
bound on the labelled sample; the raw counts cover all documents).

Nulls and texts without words have zero counts and fail the base rules.
Repeated rows give a row each.  Without labelled documents the score of all
documents is zero, and the base rules alone decide; an empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskscope.llm.common import keyed_text

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
THRESHOLD = -150_000     # millionths of a nat per n-gram
SMOOTHING = 8.0          # added to each bucket of both, at the target's size
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
_SPACE = r"[ \t-\r]+"
_PUNCTUATION = r"[!-/:-@\[-`{-~]+"
_SAME = 4711             # any number: the pair of a token and itself


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside ``body``: inside a lambda an inlined
    expression would be evaluated anew for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def tokens(text: Column) -> Column:
    """Words, with runs of ASCII punctuation as tokens of their own."""
    return words(F.regexp_replace(text, _PUNCTUATION, " $0 "))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(BUCKETS - 1).cast("int")


def _pair(before: Column, h: Column) -> Column:
    return F.when(before == h, F.lit(_SAME)).otherwise(F.xxhash64(before, h))


def _grams(hashes: Column) -> Column:
    """Buckets of the tokens and of the token pairs, from token hashes; the
    first token pairs with nothing."""
    return F.concat(F.transform(hashes, _bucket),
                    F.transform(hashes, lambda h, i: _bucket(_pair(F.get(hashes, i - 1), h))))


def _score(hashes: Column, table: Column) -> Column:
    """The sum of the weights of ``_grams``, and how many there are."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("last"))
    return F.struct(F.aggregate(hashes, start, lambda s, h: F.struct(
        (s["sum"] + F.get(table, _bucket(h)) + F.get(table, _bucket(_pair(s["last"], h)))).alias("sum"), h.alias("last")),
        lambda s: s["sum"]).alias("sum"), (2 * F.size(hashes)).cast("long").alias("n"))


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def weights(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> list[int]:
    """log(target / raw) of every bucket, in millionths."""
    trusted = (labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__good"))
               .distinct().orderBy(F.xxhash64("__good"), "__good").limit(target_rows))
    counts = (docs.join(F.broadcast(trusted), F.col("doc_id") == F.col("__good"), "left")  # target_rows ids
              .select(F.explode(let(_hashes(tokens(F.col("text"))), _grams)).alias("bucket"), "__good")
              .groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__good").alias("good")))
    every = Window.partitionBy()  # over at most BUCKETS rows
    expected = F.col("raw") * F.sum("good").over(every) / F.sum("raw").over(every)
    scored = counts.select("bucket", F.round(1e6 * F.log((F.col("good") + SMOOTHING) / (expected + SMOOTHING)))
                           .cast("long").alias("weight"))
    out = [0] * BUCKETS
    for r in scored.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["weight"]
    return out


def _repeated(hashes: Column) -> Column:
    """Words covered by windows of REPEAT_WINDOW words that occur twice or more."""
    width = REPEAT_WINDOW

    def covered(wins: Column) -> Column:
        def marked(order: Column) -> Column:
            # Windows sorted by hash: a repeated one has an equal neighbour.
            same = lambda i, j: F.coalesce(F.get(order, j)["h"] == F.get(order, i)["h"], F.lit(False))
            starts = F.array_sort(F.transform(
                F.filter(order, lambda e, k: same(k, k - 1) | same(k, k + 1)), lambda e: e["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
            return F.aggregate(starts, zero, lambda s, at: F.struct(
                (s["n"] + F.least(F.lit(width), at - s["last"])).alias("n"), at.alias("last")), lambda s: s["n"])

        pairs = F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0)).otherwise(let(F.sort_array(pairs), marked))

    wins = F.transform(F.sequence(F.lit(0), F.size(hashes) - width),
                       lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))
    return F.when(F.size(hashes) < width, F.lit(0)).otherwise(let(wins, covered))


def _measures(text: Column, table: list[int]) -> Column:
    """A struct of the rules' measures and the score of a text."""
    text = F.coalesce(text, F.lit(""))
    weight = F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")

    def of(ws: Column, score: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"),
                        F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                        let(_hashes(ws), _repeated).cast("long").alias("n_repeat_words"),
                        score["sum"].alias("llr_micro"), score["n"].alias("n_grams"))

    return let(let(_hashes(tokens(text)), lambda h: _score(h, weight)), lambda s: let(words(text), lambda ws: of(ws, s)))


def _failed(m) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def _kept(m, threshold: int) -> Column:
    return ~_failed(m) & (m["llr_micro"] >= m["n_grams"] * threshold)


def assess(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rules' measures, the score and the verdict per document."""
    docs = keyed_text(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = docs.select(
        "doc_id", _measures(F.col("text"), weights(docs, labels)).alias("m"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))
    m = F.col("m")
    return out.select("doc_id", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words",
                      "m.llr_micro", "m.n_grams", _failed(m).alias("base_failed"), _kept(m, threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, each judged by itself, all columns kept:
    a filter, so nothing is shuffled."""
    table = weights(keyed_text(docs), labels)
    return docs.where(let(_measures(F.col("text").cast("string"), table), lambda m: _kept(m, threshold)))
