"""Score fusion, bias check, review flags and reasoning.

``fuse`` expects the rule columns of ``operators.rules.match_rules`` and the
model columns of ``operators.scoring.score_probs`` and adds the fused
result in one projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import (
    DEFAULT_FUSION, LABELS, REASON_AMPLIFIED, REASON_BIAS, REASON_HIGH_TERMS, REASON_NO_MODEL,
    REASON_REVIEW, REASON_TERMS, RISK_WEIGHTS, SENSITIVE_CATEGORIES, FusionParams,
)


def round_half_up(x: Column, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``: one rounding rule that DuckDB and
    Spark evaluate identically (built-in ``round`` differs on ties)."""
    k = float(10 ** digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k)


def ml_risk(probs: Column) -> Column:
    """sum of p_i * w_i in label order (fixed float order)."""
    acc = None
    for i, w in enumerate(RISK_WEIGHTS):
        term = F.element_at(probs, i + 1) * F.lit(float(w))
        acc = term if acc is None else acc + term
    return acc


def label_for(risk: Column, cutpoints: tuple[int, int, int]) -> Column:
    """label by cut-points."""
    c1, c2, c3 = cutpoints
    return (F.when(risk < c1, F.lit(LABELS[0]))
            .when(risk < c2, F.lit(LABELS[1]))
            .when(risk < c3, F.lit(LABELS[2]))
            .otherwise(F.lit(LABELS[3])))


def bias_check(terms: Column) -> Column:
    """F8: ``struct<high_bias_risk, risk_factors array<struct<category,terms>>,
    detected_categories array<string>>``; categories in lexicon order."""
    def members(words):
        lit = F.array(*[F.lit(w) for w in words])
        return lambda t: F.array_contains(lit, F.lower(t))

    factors = F.array(*[
        F.struct(F.lit(cat).alias("category"), F.filter(terms, members(words)).alias("terms"))
        for cat, words in SENSITIVE_CATEGORIES])
    factors = F.filter(factors, lambda f: F.size(f["terms"]) > 0)
    return F.struct(
        (F.size(factors) > 0).alias("high_bias_risk"),
        factors.alias("risk_factors"),
        F.transform(factors, lambda f: f["category"]).alias("detected_categories"),
    )


def fuse(df: DataFrame, params: FusionParams = DEFAULT_FUSION) -> DataFrame:
    """F1-F10.  Adds ``risk_score int``, ``label``, ``confidence double``,
    ``flagged_terms``, ``rule_amplification``, ``bias_metadata``,
    ``review_reasons array<string>``, ``requires_human_review``, ``reasoning``.
    """
    p = params.normalised()
    wr, wm = float(p.rule_weight), float(p.ml_weight)
    high = F.col("has_high_risk")
    rule_score = F.col("rule_risk").cast("double") / F.lit(100.0)
    rule_score = F.when(high, rule_score * F.lit(float(p.amplification))).otherwise(rule_score)
    fused = F.lit(wr) * rule_score + F.lit(wm) * ml_risk(F.col("ml_probs"))
    risk = F.least((fused * F.lit(100.0)).cast("int"), F.lit(100))

    base = F.lit(wm) * F.col("ml_confidence") + F.lit(wr) * F.when(F.col("rule_flagged"), 1.0).otherwise(0.0)
    base = F.when(high, F.least(base * F.lit(float(p.confidence_boost)), F.lit(1.0))).otherwise(base)

    df = df.withColumns({
        "risk_score": risk,
        "confidence": round_half_up(base, 2),
        "bias_metadata": bias_check(F.col("rule_terms")),
    })
    r = F.col("risk_score")
    band = None
    for lo, hi in p.review_bands:
        cond = (r >= lo) & (r <= hi)
        band = cond if band is None else band | cond
    reasons = F.array_compact(F.array(
        F.when(F.col("confidence") < p.review_confidence, F.lit("low_confidence")),
        F.when(high & (F.col("ml_label") == LABELS[0]), F.lit("rule_model_disagreement")),
        F.when(F.col("bias_metadata.high_bias_risk") & (r >= p.bias_review_min_risk), F.lit("bias_risk")),
        F.when(band, F.lit("borderline")),
    ))
    df = df.withColumns({
        "label": label_for(r, p.cutpoints),
        "flagged_terms": F.col("rule_terms"),
        "rule_amplification": high,
        "review_reasons": reasons,
        "requires_human_review": F.size(reasons) > 0,
    })
    pct = F.bround(F.col("ml_confidence") * F.lit(100.0), 0).cast("int").cast("string")
    reasoning = F.concat_ws(
        "; ",
        F.when(F.size("rule_terms") > 0,
               F.when(F.size("high_terms") > 0,
                      F.concat(F.lit(REASON_HIGH_TERMS), F.array_join(F.slice("high_terms", 1, 3), ", ")))
               .otherwise(F.concat(F.lit(REASON_TERMS), F.array_join(F.slice("rule_terms", 1, 3), ", ")))),
        F.concat(F.lit("ML model classified as '"), F.col("ml_label"), F.lit("' with "), pct, F.lit("% confidence")),
        F.when(high, F.lit(REASON_AMPLIFIED)),
        F.when(F.col("bias_metadata.high_bias_risk"), F.lit(REASON_BIAS)),
        F.when(F.col("requires_human_review"), F.lit(REASON_REVIEW)),
    )
    if "ml_missing" in df.columns:
        reasoning = F.when(F.col("ml_missing"), F.concat(reasoning, F.lit(REASON_NO_MODEL))).otherwise(reasoning)
    return df.withColumn("reasoning", reasoning)
