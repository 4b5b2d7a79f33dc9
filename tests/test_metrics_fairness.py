"""Counters, evaluation, rate limits (G9-G17, T5) and fairness."""
from pyspark.sql import functions as F

from riskscope.operators import fairness as FA
from riskscope.operators import metrics as M

def _events(spark, times, key=1):
    return spark.createDataFrame([(i, key, "view", t) for i, t in enumerate(times)],
                                 "event_id long, user_id long, event_type string, s long").withColumn(
        "ts", F.timestamp_seconds("s"))


def test_per_class_zero_filled_and_weighted(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 0)], "y_true int, y_pred int")
    pc = {r["label_id"]: r for r in M.per_class(pairs, 4).collect()}
    assert pc[3]["support"] == 0 and pc[3]["f1"] == 0.0
    assert pc[0]["precision"] == 2 / 3 and pc[0]["recall"] == 2 / 3
    em = M.eval_metrics(pairs, 4).first()
    assert em["accuracy"] == 0.6 and em["support"] == 5
    rows = {r["row"]: r for r in M.eval_report(pairs, 4).collect()}
    assert rows["accuracy"]["f1"] == 0.6 and rows["macro avg"]["support"] == 5
    dense = {r["y_true"]: (r["p0"], r["p1"], r["p2"], r["p3"]) for r in M.confusion_dense(pairs, 4).collect()}
    assert dense == {0: (2, 1, 0, 0), 1: (0, 1, 0, 0), 2: (1, 0, 0, 0), 3: (0, 0, 0, 0)}


def test_pairs_outside_the_classes_stay_in_the_totals(spark):
    pairs = spark.createDataFrame([(0, 0), (1, 1), (7, 0), (7, 7), (None, 1), (2, 9)], "y_true int, y_pred int")
    em = M.eval_metrics(pairs, 4).first()
    assert em["accuracy"] == 0.5 and em["support"] == 6
    dense = {r["y_true"]: r for r in M.confusion_dense(pairs, 4).collect()}
    assert set(dense) == {-1, 0, 1, 2, 3} and dense[2]["p_other"] == 1
    assert (dense[-1]["p0"], dense[-1]["p1"], dense[-1]["p_other"]) == (1, 1, 1)
    report = {r["row"]: r for r in M.eval_report(pairs, 4).collect()}
    assert report["other"]["support"] == 3 and report["weighted avg"]["support"] == 6


def test_counters_keep_unknown_labels_and_errors(spark):
    res = spark.createDataFrame([("Odd", True), (None, False), ("Odd", None)], "label string, requires_human_review boolean")
    rejects = spark.createDataFrame([("empty",), ("empty",), ("malformed",)], "reject_reason string")
    got = {(r["metric"], r["key"]): r["value"] for r in M.counters(res, rejects=rejects).collect()}
    assert got == {("requests_total", ""): 3, ("label_total", "Odd"): 2, ("label_total", "unknown"): 1,
                   ("review_total", "review_required"): 1, ("review_total", "no_review"): 1, ("review_total", "unknown"): 1,
                   ("errors_total", "empty"): 2, ("errors_total", "malformed"): 1}


def test_counters_and_lines(spark):
    res = spark.createDataFrame([("Non-Radical", False), ("Highly Radical", True), ("Highly Radical", True)],
                                "label string, requires_human_review boolean")
    c = {(r["metric"], r["key"]): r["value"] for r in M.counters(res).collect()}
    assert c == {("requests_total", ""): 3, ("label_total", "Non-Radical"): 1, ("label_total", "Highly Radical"): 2,
                 ("review_total", "no_review"): 1, ("review_total", "review_required"): 2}
    lines = sorted(r["line"] for r in M.exposition_lines(M.counters(res)).collect())
    assert 'riskscope_label_total{label="Highly Radical"} 2' in lines and "riskscope_requests_total 3" in lines


def test_rate_limit(spark):
    ev = _events(spark, [0, 10, 20, 30, 86_400 + 5])
    f = M.rate_limit_flags(ev, "user_id", "ts", "1 day", 3).collect()
    assert [(r["user_id"], r["n"]) for r in f] == [(1, 4)]


def _results(spark, rows):
    return spark.createDataFrame(rows, "label string, bias_metadata struct<high_bias_risk:boolean,"
                                       "detected_categories:array<string>>, lang string")


def test_fairness_report(spark):
    rows = ([("Highly Radical", (True, ["religion"]), "en")] * 4 + [("Non-Radical", (True, ["political"]), "en")] * 4
            + [("Non-Radical", (False, []), "fr")] * 2)
    res = _results(spark, rows)
    con = {r["category"]: (r["severity"], r["disparate_impact_ratio"]) for r in FA.concerns(res).collect()}
    assert con == {"religion": ("medium", 2.5), "political": ("high", 0.0)}
    s = FA.summary(res).first()
    assert (s["total_processed"], s["flagged_count"], s["flagged_rate"], s["bias_risk_rate"]) == (10, 4, 0.4, 0.8)
    assert s["fairness_score"] == 0.8 and s["requires_fairness_review"]
    g = {r["lang"]: r for r in FA.group_rates(res, "lang", "en").collect()}
    assert g["fr"]["disparate_impact_ratio"] == 0.0 and g["fr"]["parity_difference"] == 0.5


def test_fairness_empty(spark):
    s = FA.summary(_results(spark, [])).first()
    assert (s["total_processed"], s["fairness_score"], s["requires_fairness_review"]) == (0, 1.0, False)


def test_equalized_odds(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 1, 0), ("b", 0, 1)], "g string, truth int, pred int")
    r = {x["g"]: x["equalized_odds_difference"] for x in FA.odds_by_group(df, "g", "a").collect()}
    assert r == {"a": 0.0, "b": 1.0}


def test_counters_empty_input(spark):
    empty = spark.createDataFrame([], "label string, requires_human_review boolean")
    assert [tuple(r) for r in M.counters(empty).collect()] == [("requests_total", "", 0)]


def test_hot_text_dedupe_and_scoring(spark):
    """One text holds a large share of all rows; results stay exact."""
    from riskscope.operators import dataset as D
    from riskscope.operators import scoring as S

    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"t{i}") for i in range(3000)],
                                 "doc_id long, text string").repartition(8)
    kept = D.dedupe_text(docs, "doc_id").collect()
    assert len(kept) == 2001 and min(r["doc_id"] for r in kept if r["text"] == "same text") == 0
    scored = S.score_distinct(docs, "text", lambda u: u.withColumn("probs", F.array(F.length("text").cast("double"))))
    assert scored.filter("text = 'same text'").select(F.countDistinct("probs")).first()[0] == 1
    assert scored.count() == 3000


def _fair_py(rows):
    import math

    def r4(x):
        return math.floor(x * 10_000 + 0.5) / 10_000

    total = len(rows)
    flagged = sum(1 for lab, _ in rows if lab != "Non-Radical")
    bias = sum(1 for _, cats in rows if cats)
    ref = flagged / total if total else 0.0
    stats = {}
    for lab, cats in rows:
        for c in cats:
            t, p = stats.get(c, (0, 0))
            stats[c] = (t + 1, p + (lab != "Non-Radical"))
    concerns = {}
    for c, (t, p) in stats.items():
        pr = p / t
        di = 0.0 if ref == 0 else pr / ref
        if di < 0.8 or di > 1 / 0.8:
            concerns[c] = "high" if di < 0.5 else "medium"
    hi = sum(1 for s in concerns.values() if s == "high")
    me = len(concerns) - hi
    score = r4(max(0.0, 1.0 - (0.3 * hi + 0.1 * me) / max(1, len(concerns)))) if total else 1.0
    return (total, flagged, r4(flagged / total) if total else 0.0, bias, score, hi > 0), concerns


def test_fairness_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    labels = st.sampled_from(["Non-Radical", "Mildly Radical", "Highly Radical"])
    cats = st.lists(st.sampled_from(["religion", "political", "identity"]), unique=True, max_size=3)

    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.tuples(labels, cats), min_size=1, max_size=60))
    def check(rows):
        ordered = [(lab, [c for c in ("religion", "political", "identity") if c in cs]) for lab, cs in rows]
        res = _results(spark, [(lab, (bool(cs), cs), "en") for lab, cs in ordered])
        want_summary, want_concerns = _fair_py(ordered)
        s = FA.summary(res).first()
        got = (s["total_processed"], s["flagged_count"], s["flagged_rate"], s["bias_risk_count"],
               s["fairness_score"], s["requires_fairness_review"])
        assert got == want_summary
        assert {r["category"]: r["severity"] for r in FA.concerns(res).collect()} == want_concerns

    check()


def test_eval_metrics_property(spark):
    import math

    from hypothesis import given, settings
    from hypothesis import strategies as st

    def r6(x):
        return math.floor(x * 1_000_000 + 0.5) / 1_000_000

    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=80))
    def check(pairs):
        n = len(pairs)
        per = []
        for c in range(4):
            tp = sum(1 for t, p in pairs if t == c and p == c)
            fp = sum(1 for t, p in pairs if t != c and p == c)
            fn = sum(1 for t, p in pairs if t == c and p != c)
            prec = tp / (tp + fp) if tp + fp else 0.0
            rec = tp / (tp + fn) if tp + fn else 0.0
            f1 = 2.0 * prec * rec / (prec + rec) if prec + rec else 0.0
            per.append((prec, rec, f1, tp + fn))
        acc = sum(1 for t, p in pairs if t == p) / n

        def wavg(i):
            s = 0.0
            for row in per:
                s += row[i] * row[3]
            return s / n
        df = spark.createDataFrame(pairs, "y_true int, y_pred int")
        m = M.eval_metrics(df, 4).first()
        assert (m["accuracy"], m["precision"], m["recall"], m["f1"], m["support"]) == (
            r6(acc), r6(wavg(0)), r6(wavg(1)), r6(wavg(2)), n)
        pc = {r["label_id"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in M.per_class(df, 4).collect()}
        assert pc == {c: per[c] for c in range(4)}

    check()
