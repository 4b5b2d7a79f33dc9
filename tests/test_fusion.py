"""Fusion, labels, confidence, review and reasoning."""
import pymodel
import pytest
from pyspark.sql import functions as F

from riskscope.operators.fusion import fuse
from riskscope.operators.scoring import score_probs
from riskscope.params import AS_CODED_FUSION, DEFAULT_FUSION, FusionParams

SCHEMA = ("rule_risk int, has_high_risk boolean, rule_flagged boolean, rule_terms array<string>, "
          "high_terms array<string>, probs array<double>")


def _fuse(spark, rows, params=DEFAULT_FUSION):
    df = spark.createDataFrame(rows, SCHEMA)
    return fuse(score_probs(df, "probs"), params).collect()


def _risk_rows(target):
    # ML risk only: probabilities chosen so that 0.7 * ml_risk * 100 lands on target
    p3 = target / 70.0
    return (0, False, False, [], [], [1.0 - p3, 0.0, 0.0, p3])


@pytest.mark.parametrize("risk,intended,as_coded", [
    (10, "Non-Radical", "Non-Radical"), (30, "Mildly Radical", "Non-Radical"),
    (60, "Moderately Radical", "Mildly Radical"), (69, "Moderately Radical", "Mildly Radical")])
def test_labels_both_profiles(spark, risk, intended, as_coded):
    r = _fuse(spark, [_risk_rows(risk + 0.5)])[0]
    assert r["risk_score"] == risk and r["label"] == intended
    assert _fuse(spark, [_risk_rows(risk + 0.5)], AS_CODED_FUSION)[0]["label"] == as_coded


def test_high_risk_case_and_amplification(spark):
    row = (30, True, True, ["kill", "attack", "bomb", "enemy"], ["kill", "attack", "bomb"], [0.0, 0.01, 0.04, 0.95])
    r = _fuse(spark, [row])[0]
    want = pymodel.fuse({"flagged": True, "terms": row[3], "risk": 30, "high": row[4]}, row[5])
    assert r["risk_score"] == want["risk_score"] > 60
    assert r["confidence"] == want["confidence"] > 0.7
    assert r["rule_amplification"] and r["label"] == "Highly Radical"
    assert r["reasoning"].startswith("High-risk terms detected: kill, attack, bomb")


def test_low_confidence_needs_review(spark):
    r = _fuse(spark, [(0, False, False, [], [], [0.4, 0.3, 0.2, 0.1])])[0]
    assert r["confidence"] < 0.5 and r["requires_human_review"] and "low_confidence" in r["review_reasons"]


def test_bias_and_disagreement(spark):
    row = (8, True, True, ["jihad", "struggle", "faith"], ["jihad"], [0.97, 0.01, 0.01, 0.01])
    r = _fuse(spark, [row])[0]
    assert r["bias_metadata"]["high_bias_risk"]
    assert r["bias_metadata"]["detected_categories"] == ["religion", "political"]
    assert [f["terms"] for f in r["bias_metadata"]["risk_factors"]] == [["jihad", "faith"], ["struggle"]]
    assert "rule_model_disagreement" in r["review_reasons"]


def test_fallback_note(spark):
    r = _fuse(spark, [(0, False, False, [], [], None)])[0]
    assert r["ml_missing"] and r["ml_label"] == "Non-Radical" and r["ml_confidence"] == 0.5
    assert r["reasoning"].endswith("(ML model unavailable: no model score for this row)")
    assert "with 50% confidence" in r["reasoning"]


def test_weight_normalisation():
    p = FusionParams(rule_weight=0.6, ml_weight=1.4).normalised()
    assert abs(p.rule_weight - 0.3) < 1e-12 and abs(p.ml_weight - 0.7) < 1e-12
    assert FusionParams(rule_weight=0.0, ml_weight=0.0).normalised().rule_weight == 0.0


def test_classify_texts_that_clean_to_nothing(spark):
    from riskscope.plans.classify import classify, flat_result
    df = spark.createDataFrame([(1, "!!!"), (2, "😀😀"), (3, "@someone"), (4, "x")], "doc_id long, text string")
    rows = flat_result(classify(df.withColumn("probs", F.lit(None).cast("array<double>")))).collect()
    assert len(rows) == 4 and all(r["flagged_terms"] == "" and r["label"] == "Non-Radical" for r in rows)


def test_classify_without_scores_uses_fallback(spark):
    from riskscope.plans.classify import classify
    r = classify(spark.createDataFrame([(1, "kill them all")], "doc_id long, text string")).first()
    assert r["ml_missing"] and r["flagged_terms"] == ["kill"] and "ML model unavailable" in r["reasoning"]


def test_classify_batches_rejects_whole_batches(spark):
    from riskscope.plans.classify import classify_batches
    df = spark.createDataFrame([(1, 0, "kill"), (1, 1, "fine"), (2, 0, "ok"), (2, 1, ""), (3, 0, "x"), (3, 1, "y"),
                                (3, 2, "z")], "batch_id int, item_idx int, text string")
    res, rej = classify_batches(df, max_batch=2)
    assert sorted(r["request_id"] for r in res.collect()) == ["1_0", "1_1"]
    assert {r["batch_id"]: r["verdict"] for r in rej.collect()} == {2: "empty_item", 3: "batch_too_large"}
