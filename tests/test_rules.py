"""Rule matching."""
import pymodel
from pyspark.sql import functions as F

from riskscope.functions.text import clean
from riskscope.operators import rules as R
from riskscope.operators.rules import collect_hits, match_rules, rule_group_stats, rule_hits_long, rules_frame
from riskscope.params import Lexicon
from riskscope.plans.corpus import SEED_PHRASES


def _ruled(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return match_rules(df.withColumn("cleaned", clean("text")), "cleaned").orderBy("doc_id")


def test_seed_phrases_match_python(spark):
    rows = _ruled(spark, list(SEED_PHRASES)).collect()
    for r, text in zip(rows, SEED_PHRASES):
        want = pymodel.analyze(pymodel.clean(text))
        assert r["rule_terms"] == want["terms"], text
        assert r["rule_risk"] == want["risk"]
        assert r["high_terms"] == want["high"]


def test_word_boundaries(spark):
    rows = _ruled(spark, ["killing time", "kill", "the enemy's plan", "our'people", "our people", "holy  war"]).collect()
    assert [r["kw_hits"] for r in rows] == [[], ["kill"], ["enemy"], [], ["our people"], ["holy war"]]


def test_patterns_unanchored_and_counted_once(spark):
    rows = _ruled(spark, ["the recruitment drive is complicity", "rise up and rise up"]).collect()
    assert rows[0]["rule_terms"] == ["recruit", "complicit", "complicity"]
    assert rows[1]["pattern_count"] == 1 and rows[1]["rule_risk"] == 2


def test_high_risk_flag_and_cap(spark):
    rows = _ruled(spark, ["we will attack", "fight for rights", SEED_PHRASES[15]]).collect()
    assert rows[0]["has_high_risk"] and not rows[1]["has_high_risk"]
    assert rows[2]["rule_risk"] == 100
    assert dict(rows[1]["kw_by_severity"]) == {"low_risk": ["fight", "rights"]}


def test_join_plan_equals_literal_plan(spark):
    texts = list(SEED_PHRASES) + ["nothing here", "x'our people's cause"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = df.withColumn("cleaned", clean("text"))
    lit = {r["doc_id"]: r["rule_terms"] for r in match_rules(df, "cleaned").collect() if r["rule_terms"]}
    long_ = rule_hits_long(df, rules_frame(spark), "doc_id", "cleaned")
    joined = {r["doc_id"]: r["rule_terms"] for r in collect_hits(long_).collect()}
    assert joined == lit
    stats = {(r["kind"], r["group"]): r["hits"] for r in rule_group_stats(long_).collect()}
    assert stats[("keyword", "high_risk")] >= 18


def test_yaml_lexicon(tmp_dir):
    import os
    p = os.path.join(tmp_dir, "rules.yaml")
    with open(p, "w") as f:
        f.write("keywords:\n  high_risk: [boom]\n  custom: [zap]\npatterns:\n  misc: ['big bang']\n")
    lx = Lexicon.from_yaml(p)
    assert lx.all_keywords() == ["boom", "zap"]
    assert lx.weight("custom") == 1  # unknown severity weighs 1
    assert [r[1:4] for r in lx.rows()] == [("keyword", "high_risk", "boom"), ("keyword", "custom", "zap"),
                                           ("pattern", "misc", "big bang")]


def test_lexicon_round_trip_through_a_table(spark):
    from riskscope.operators.rules import lexicon_from_frame
    from riskscope.params import DEFAULT_LEXICON
    lx = lexicon_from_frame(rules_frame(spark))
    assert lx.keywords == DEFAULT_LEXICON.keywords and lx.patterns == DEFAULT_LEXICON.patterns
    assert all(lx.weight(s) == DEFAULT_LEXICON.weight(s) for s, _ in lx.keywords)
    a = _ruled(spark, list(SEED_PHRASES)).select("rule_terms", "rule_risk").collect()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SEED_PHRASES)], "doc_id long, text string")
    b = match_rules(df.withColumn("cleaned", clean("text")), "cleaned", lx).orderBy("doc_id").select(
        "rule_terms", "rule_risk").collect()
    assert a == b


def test_random_phrases_match_python_model(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    words = st.sampled_from([
        "kill", "killing", "holy", "war", "our", "people", "us", "versus", "them", "enemy", "rights", "rise",
        "up", "must", "recruitment", "complicity", "they", "don't", "want", "you", "to", "know", "wake",
        "new", "world", "order", "no", "quarter", "jihad", "faith", "'", "'s", " ", "  ", ",", "x",
    ])
    phrases = st.lists(st.lists(words, max_size=10).map(" ".join), min_size=200, max_size=200)

    @settings(max_examples=5, deadline=None)
    @given(phrases)
    def check(batch):
        rows = _ruled(spark, batch).collect()
        for r, text in zip(rows, batch):
            want = pymodel.analyze(pymodel.clean(text))
            assert (r["rule_terms"], r["rule_risk"], r["high_terms"]) == (want["terms"], want["risk"], want["high"]), text

    check()


def test_literal_lexicon_size_guard(spark, monkeypatch):
    import pytest

    from riskscope.operators import rules as R
    monkeypatch.setattr(R, "MAX_LITERAL_RULES", 10)
    with pytest.raises(ValueError, match="too many"):
        R.lexicon_from_frame(rules_frame(spark))


def test_terms_are_reported_as_written(spark):
    from riskscope.params import Lexicon
    lexicon = Lexicon(keywords=(("low", ("Enemy", "calm")), ("high", ("O'Hara",))), patterns=(), severity_weights={"low": 1, "high": 9})
    df = spark.createDataFrame([(1, "the enemy and o'hara stay calm")], "doc_id long, cleaned string")
    assert match_rules(df, "cleaned", lexicon).first()["rule_terms"] == ["Enemy", "calm", "O'Hara"]


def _long(df):
    return sorted(tuple(r) for r in df.collect())


def test_many_patterns_by_q_grams_equal_literals(spark):
    """Patterns looked up by their rarest q-gram give what literal tests give:
    short ones, with spaces and apostrophes, over word ends, in long words."""
    import random
    rng = random.Random(2)
    letters = "abcde"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += ["", "a", "they're here", "x" * 3000 + "needle" + "y" * 700, "don't stop", "recruitment drive"]
    patterns = sorted({"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(400)} | {
        "a b", "b", "y're h", "recruit", "needle", "xxneedley", "n't st", "t d", "Needle"})
    rules = spark.createDataFrame([(i, "pattern", "g", p, 2) for i, p in enumerate(patterns)] + [
        (9000, "pattern", "g", "a+b", 2), (9001, "keyword", "k", "don't", 1)], R.RULES_SCHEMA)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, cleaned string")
    got = _long(R.rule_hits_long(df, rules, literal_patterns=5))
    assert got == _long(R.rule_hits_long(df, rules, literal_patterns=10000))
    want = sorted((i, n, "pattern", "g", p, 2) for i, t in enumerate(texts) for n, p in enumerate(patterns) if p.lower() in t)
    assert [r for r in got if r[1] < 9000] == want


def test_long_terms_by_their_rarest_word(spark):
    """Terms of up to eight words, sharing words, against a regex each."""
    import random
    import re
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["a", "b"]
    texts = [rng.choice([" ", "'"]).join(rng.choices(words, k=rng.randint(0, 80))) for _ in range(60)]
    texts += [" ".join(rng.choices(words, k=200)) for _ in range(40)] + ["a b", "a  b", "a'b", "'a b'", "xa b"]
    terms = sorted({" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(300)} | {
        " ".join(t.replace("'", " ").split()[3:9]) or "a" for t in texts[60:100]} | {"a b", "A B", "W1"})
    rules = spark.createDataFrame([(i, "keyword", "k", t, 1) for i, t in enumerate(terms)], R.RULES_SCHEMA)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, cleaned string")
    want = sorted((i, n, "keyword", "k", t, 1) for i, x in enumerate(texts) for n, t in enumerate(terms)
                  if re.search(r"\b" + re.escape(t.lower()) + r"\b", x))
    assert _long(R.rule_hits_long(df, rules)) == want and want


def test_empty_lexicon_and_odd_terms(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "doc_id long, cleaned string")
    assert R.rule_hits_long(df, spark.createDataFrame([], R.RULES_SCHEMA)).collect() == []
    rules = spark.createDataFrame([(0, "pattern", "g", " ", 1), (1, "keyword", "k", "#b", 1), (2, "keyword", "k", "b", 1)], R.RULES_SCHEMA)
    assert _long(R.rule_hits_long(df, rules)) == [(1, 0, "pattern", "g", " ", 1), (1, 2, "keyword", "k", "b", 1)]
