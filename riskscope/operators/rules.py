"""Lexicon rule matching.

Keywords match whole words of the cleaned text (``\\bterm\\b``), each keyword
counted once per text, reported in file order.  Patterns match anywhere in
the cleaned text (unanchored, case-insensitive): ``recruit`` hits
``recruitment``.

Two physical plans with the same result:

* ``match_rules`` (default): the lexicon is a literal.  Single-word keywords
  are found by ``array_intersect`` of the literal keyword array with the
  tokens of the cleaned text split on space *and* apostrophe (``\\b`` treats
  ``'`` as a boundary); keywords with a space or apostrophe get one literal
  ``rlike`` each; each pattern is one literal ``contains`` (or ``rlike`` if
  it has regex syntax).  Narrow, no shuffle, whole-stage codegen.
* ``rule_hits_long``: relational form for large lexicons - each term is looked
  up by its rarest word, each pattern by its rarest q-gram, and candidates are
  verified on the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import DEFAULT_LEXICON, Lexicon
from ..session import scratch_path

_META = set(".^$*+?{}[]\\|()")
_WORD = re.compile(r"[a-z0-9]+")

RULES_SCHEMA = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("group", T.StringType(), False),
    T.StructField("term", T.StringType(), False),
    T.StructField("weight", T.IntegerType(), False),
])

def regex_escape(s: str) -> str:
    """Escape regex metacharacters (same result for Java regex and RE2)."""
    return "".join("\\" + ch if ch in _META else ch for ch in s)


def is_plain(pattern: str) -> bool:
    return not any(ch in _META for ch in pattern)


def word_regex(term: str) -> str:
    return r"\b" + regex_escape(term.lower()) + r"\b"


def rules_frame(spark: SparkSession, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """The lexicon as a small table ``(ord, kind, group, term, weight)``."""
    return spark.createDataFrame(lexicon.rows(), RULES_SCHEMA)


#: Largest rules table turned into literal expressions (beyond it, use the
#: join plan ``rule_hits_long``).
MAX_LITERAL_RULES = 10_000


def lexicon_from_frame(rules: DataFrame, pattern_weight: int = 2) -> Lexicon:
    """S6 from any table ``(ord, kind, group, term, weight)``: a literal
    lexicon for ``match_rules``.  The row count is checked before the
    (small) table is collected; groups and terms keep ``ord`` order, and a
    keyword group's weight is taken from its rows."""
    n = rules.count()
    if n > MAX_LITERAL_RULES:
        raise ValueError(f"{n} rules: too many for literal matching; use rule_hits_long")
    kws: dict[str, list[str]] = {}
    pats: dict[str, list[str]] = {}
    weights: dict[str, int] = {}
    for r in rules.orderBy("ord").collect():
        if r["kind"] == "keyword":
            kws.setdefault(r["group"], []).append(r["term"])
            weights[r["group"]] = int(r["weight"])
        else:
            pats.setdefault(r["group"], []).append(r["term"])
    return Lexicon(keywords=tuple((g, tuple(t)) for g, t in kws.items()),
                   patterns=tuple((g, tuple(t)) for g, t in pats.items()),
                   severity_weights=weights, pattern_weight=pattern_weight)


def _lit_array(values) -> Column:
    vals = list(values)
    if not vals:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in vals])


def keyword_tokens(cleaned: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Split tokens plus the literal hits of keywords that are not one word."""
    toks = F.split(cleaned, "[' ]")
    odd = [t for t in lexicon.all_keywords() if not _WORD.fullmatch(t.lower())]
    if not odd:
        return toks
    # a word-boundary match needs the literal substring: test that first
    # (byte search), so the regex only runs on the few texts that hold it
    extra = F.array_compact(F.array(*[F.when(cleaned.contains(t.lower()) & cleaned.rlike(word_regex(t)),
                                             F.lit(t.lower())) for t in odd]))
    return F.concat(toks, extra)


def _spelling(written: dict[str, str]):
    names = F.create_map(*[F.lit(x) for pair in written.items() for x in pair])
    return lambda t: F.coalesce(F.try_element_at(names, t), t)


def match_rules(df: DataFrame, cleaned_col: str = "cleaned", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """D1-D7.  Adds:

    ``kw_hits array<string>`` (severity order, then file order),
    ``kw_by_severity map<string,array<string>>`` (no empty groups),
    ``kw_points int``, ``high_terms array<string>``,
    ``pattern_hits array<struct<category,pattern>>``, ``pattern_count int``,
    ``rule_terms array<string>`` (keywords then patterns), ``rule_risk int``
    (capped at 100), ``rule_flagged boolean``, ``has_high_risk boolean``.
    """
    c = F.col(cleaned_col)
    all_kw = [t.lower() for t in lexicon.all_keywords()]
    # One hash-based intersection against the whole lexicon, then cheap
    # per-severity intersections of that short result (file order kept).
    df = df.withColumn("__kw_all", F.array_intersect(_lit_array(dict.fromkeys(all_kw)), keyword_tokens(c, lexicon)))
    sev_cols = []
    for sev, terms in lexicon.keywords:
        name = f"__kw_{len(sev_cols)}"
        sev_cols.append((sev, name))
        hits = F.array_intersect(_lit_array(dict.fromkeys(t.lower() for t in terms)), F.col("__kw_all"))
        written = {t.lower(): t for t in reversed(terms) if t != t.lower()}
        if written:  # report terms as the lexicon writes them
            hits = F.transform(hits, _spelling(written))
        df = df.withColumn(name, hits)

    pat_exprs = []
    for cat, pats in lexicon.patterns:
        for p in pats:
            hit = c.contains(p.lower()) if is_plain(p) else c.rlike("(?i)" + p)
            pat_exprs.append(F.when(hit, F.struct(F.lit(cat).alias("category"), F.lit(p).alias("pattern"))))
    if pat_exprs:
        pattern_hits = F.array_compact(F.array(*pat_exprs))
    else:
        pattern_hits = F.array().cast("array<struct<category:string,pattern:string>>")
    df = df.withColumn("pattern_hits", pattern_hits)

    if sev_cols:
        kw_hits = F.concat(*[F.col(n) for _, n in sev_cols])
        points = sum((F.size(F.col(n)) * F.lit(lexicon.weight(s)) for s, n in sev_cols), F.lit(0))
        by_sev = F.map_filter(
            F.map_from_arrays(_lit_array([s for s, _ in sev_cols]), F.array(*[F.col(n) for _, n in sev_cols])),
            lambda k, v: F.size(v) > 0)
    else:
        kw_hits = F.array().cast("array<string>")
        points = F.lit(0)
        by_sev = F.create_map().cast("map<string,array<string>>")
    high = [n for s, n in sev_cols if s == lexicon.high_group]
    high_terms = F.col(high[0]) if high else F.array().cast("array<string>")

    df = df.withColumns({
        "kw_hits": kw_hits,
        "kw_by_severity": by_sev,
        "kw_points": points.cast("int"),
        "high_terms": high_terms,
        "pattern_count": F.size("pattern_hits"),
    })
    df = df.withColumns({
        "rule_terms": F.concat(F.col("kw_hits"), F.transform("pattern_hits", lambda x: x["pattern"])),
        "rule_risk": F.least(F.col("kw_points") + F.col("pattern_count") * F.lit(lexicon.pattern_weight),
                             F.lit(100)).cast("int"),
        "rule_flagged": (F.size("kw_hits") > 0) | (F.col("pattern_count") > 0),
        "has_high_risk": F.size(high_terms) > 0,
    })
    return df.drop("__kw_all", *[n for _, n in sev_cols])


#: Plain patterns up to this many are tested as literals; more are found by
#: their q-grams.
LITERAL_PATTERNS = 256
#: Characters of the piece by which a pattern is looked up.
PATTERN_GRAM = 4
_GRAM = "\x01"     # marks q-grams: no cleaned text has it
_FILTER_BITS = 1 << 22


def signatures(rules: DataFrame, literal_patterns: int = LITERAL_PATTERNS) -> tuple[DataFrame, list]:
    """The lookup table of a lexicon, and the rules that need a literal test.

    Every keyword is looked up by its rarest word, every plain pattern by the
    rarest q-gram of its words (after a mark); rare within the lexicon, then the
    longer, then the first by name.  ``needle`` is what a candidate's text must
    contain; null where the lookup settles it.  Keywords with an apostrophe and regex patterns have no such
    key: they are literal rules, ``MAX_LITERAL_RULES`` at most."""
    low = rules.withColumn("__low", F.lower("term"))
    pattern = F.col("kind") == "pattern"
    plain = pattern & ~F.col("term").rlike(r"[.^$*+?{}\[\]\\|()]") & F.col("__low").rlike("[^ ]")
    by_word = ~pattern & ~F.col("term").contains("'") & F.col("__low").rlike("[^ ]")
    n_plain, n_other = low.agg(F.count_if(plain), F.count_if(~plain & ~by_word)).first()
    by_gram = plain if n_plain > literal_patterns else F.lit(False)
    literal = []
    if n_other <= MAX_LITERAL_RULES:
        literal = low.where(~(by_gram | by_word)).drop("__low").orderBy("ord").collect()   # few: counted
    else:
        raise ValueError(f"over {MAX_LITERAL_RULES} regex patterns and terms with an apostrophe: too many for literal matching")

    words = F.filter(F.split("__low", " "), lambda w: w != "")
    pieces = F.when(pattern, _word_grams(words, F.least(F.lit(PATTERN_GRAM), F.array_max(F.transform(words, F.length))))).otherwise(words)
    keys = low.where(by_gram | by_word).select("ord", F.explode(F.array_distinct(pieces)).alias("gram"))
    often = keys.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = keys.join(often, "gram").groupBy("ord").agg(F.min_by("gram", F.struct("n", -F.length("gram"), "gram")).alias("gram"))
    needle = F.when(pattern, F.col("__low")).when(F.size(words) > 1, F.concat(F.lit(" "), "__low", F.lit(" ")))
    found = low.join(best, "ord").select("gram", needle.alias("needle"), "ord", "kind", "group", "term", "weight")
    if literal:
        sure = low.where(~(by_gram | by_word)).select(F.concat(F.lit("="), F.col("ord").cast("string")).alias("gram"),
                                                      F.lit(None).cast("string").alias("needle"), "ord", "kind", "group", "term", "weight")
        found = found.unionByName(sure)
    return found, literal


def _word_grams(words: Column, width: Column) -> Column:
    """A mark and each run of ``width`` characters of the words.  Long words are cut
    into overlapping pieces first, so the work stays in proportion."""
    piece = 256

    def grams(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(w) - width + 1, F.lit(1)))
        whole = F.transform(at, lambda i: F.concat(F.lit(_GRAM), F.substring(w, i, width)))
        return F.when(F.length(w) >= width, whole).otherwise(F.array().cast("array<string>"))

    def pieces(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / piece).cast("int")),
                           lambda c: F.substring(w, c * piece + 1, F.lit(piece) + width - 1))

    return F.flatten(F.transform(F.flatten(F.transform(words, pieces)), grams))


def _lookup_filter(grams: DataFrame, n: int):
    """A test for arrays of grams: whether one may be in the lookup table, by
    a literal of at most ``_FILTER_BITS`` bits."""
    bits = 1 << 10
    while bits < 16 * n and bits < _FILTER_BITS:
        bits *= 2
    words = [0] * (bits // 64)
    for r in grams.select(F.expr(f"pmod(xxhash64(gram), {bits})").alias("at")).groupBy(F.expr("at div 64").alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b")).collect():
        words[r.w] = r.b
    table = F.from_json(F.lit(str(words)), "array<bigint>")
    test = lambda g: F.getbit(F.get(table, F.floor(F.pmod(F.xxhash64(g), F.lit(bits)) / 64).cast("int")),
                              F.pmod(F.xxhash64(g), F.lit(64)).cast("int")) == 1
    return test


def rule_hits_long(df: DataFrame, rules: DataFrame, key: str = "doc_id", cleaned_col: str = "cleaned",
                   literal_patterns: int = LITERAL_PATTERNS) -> DataFrame:
    """Hits in long form ``(key, ord, kind, group, term, weight)``, for a
    lexicon of any size.

    A text's distinct words (and, with many patterns, their q-grams) that may
    be in the lookup table (``signatures``) become rows and meet it on equality;
    candidates are then verified on the text.  One pass over the texts; the
    planner picks the join from the table's size.
    """
    table, literal = signatures(rules, literal_patterns)
    c = F.col(cleaned_col)
    path = scratch_path(df.sparkSession, "rule-signatures")
    table.write.parquet(path)
    table = df.sparkSession.read.parquet(path)
    n, sizes = table.agg(F.count_distinct("gram"), F.collect_set(
        F.when(F.col("gram").startswith(_GRAM), F.length("gram") - 1))).first()
    words = F.array_distinct(F.split(F.translate(c, "'", " "), " "))
    # Pattern words are split by spaces alone, as the text is for them.
    runs = F.array_distinct(F.split(c, " "))
    grams = F.concat(words, *(F.array_distinct(_word_grams(runs, F.lit(q))) for q in sorted(sizes)))
    found = F.filter(grams, _lookup_filter(table.select("gram"), n))
    if literal:
        test = lambda r: (c.rlike(word_regex(r["term"])) if r["kind"] == "keyword" else
                          c.contains(r["term"].lower()) if is_plain(r["term"]) else c.rlike("(?i)" + r["term"]))
        found = F.concat(found, F.array_compact(F.array(*[F.when(test(r), F.lit(f"={r['ord']}")) for r in literal])))
    # Below the explode, so that a text is padded once and not once a candidate;
    # outer, since for an inner one Catalyst filters by the whole expression first.
    spaced = F.concat(F.lit(" "), F.replace(c, F.lit("'"), F.lit(" ' ")), F.lit(" "))
    texts = df.select(F.col(key), c.alias("__text"), spaced.alias("__spaced"), found.alias("__grams"))
    holds = F.when(F.col("kind") == "pattern", F.col("__text")).otherwise(F.col("__spaced")).contains(F.col("needle"))
    rows = texts.select(key, "__text", "__spaced", F.explode_outer("__grams").alias("gram"))
    return rows.join(table, "gram").where(F.col("needle").isNull() | holds).select(key, "ord", "kind", "group", "term", "weight")


def collect_hits(long_hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Back from long form to one row per key: terms in ``ord`` order.
    One shuffle on the key; each group holds at most one row per rule."""
    return (long_hits.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("ord", "term"))).alias("__h"))
            .select(key, F.transform("__h", lambda x: x["term"]).alias("rule_terms")))


def term_frequency(long_hits: DataFrame) -> DataFrame:
    """D8 use: documents per rule term ``(ord, kind, group, term, docs)``.
    Long hits hold one row per (document, rule), so a partial + final count
    per term is exact; a term hit by a third of all documents is reduced
    map-side."""
    return long_hits.groupBy("ord", "kind", "group", "term").agg(F.count(F.lit(1)).alias("docs"))


def rule_group_stats(long_hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per (kind, group): documents hit, hits and points.
    Long hits are distinct per (key, rule), so a plain count is exact."""
    return (long_hits.groupBy("kind", "group")
            .agg(F.countDistinct(key).alias("docs"), F.count(F.lit(1)).alias("hits"),
                 F.sum("weight").cast("bigint").alias("points")))
