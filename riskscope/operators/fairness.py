"""Fairness reports over classification results.

Inputs are result frames with ``label`` and ``bias_metadata`` (see
``operators.fusion``).  Every report is one scan of the results and one
partial + final hash aggregate; reference rates are attached to the
resulting few-row tables by a window, never by a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DI_HIGH_BELOW, DI_THRESHOLD, LABELS
from ..session import materialize
from .fusion import round_half_up

NON = LABELS[0]


def _flagged() -> Column:
    return F.col("label") != F.lit(NON)


def _rate(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def disparate_impact(group_rate: Column, reference_rate: Column) -> Column:
    """Group / reference, 0 when the reference rate is 0."""
    return F.when(reference_rate == 0, F.lit(0.0)).otherwise(group_rate / reference_rate)


def parity_difference(group_rate: Column, reference_rate: Column) -> Column:
    """``abs(group - reference)``."""
    return F.abs(group_rate - reference_rate)


def odds_difference(g_tpr: Column, r_tpr: Column, g_fpr: Column, r_fpr: Column) -> Column:
    """``(abs(dTPR) + abs(dFPR)) / 2``."""
    return (F.abs(g_tpr - r_tpr) + F.abs(g_fpr - r_fpr)) / F.lit(2.0)


def category_counts(results: DataFrame) -> DataFrame:
    """``(category, total, positive, bias_count)``: a row per category plus one
    with ``category = null`` for all results.  Each result is exploded into
    ``[null] + detected_categories`` (at most 4 rows), so one scan and one
    partial + final aggregate give the overall counts and the per-category
    counts together.  Counts of several inputs may be added up."""
    cats = F.concat(F.array(F.lit(None).cast("string")), F.col("bias_metadata.detected_categories"))
    return (results.select(F.explode(cats).alias("category"), _flagged().alias("pos"),
                           F.col("bias_metadata.high_bias_risk").alias("bias"))
            .groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("pos").alias("positive"),
                                     F.count_if("bias").alias("bias_count")))


def _table(results: DataFrame) -> DataFrame:
    """The counts and rates behind every fairness figure; the overall positive
    rate is attached to every row by a window over this (few-row) table."""
    t = category_counts(results)
    everything = Window.partitionBy(F.lit(1))
    ref = F.max(F.when(F.col("category").isNull(), _rate(F.col("positive"), F.col("total")))).over(everything)
    t = t.withColumn("reference_rate", F.coalesce(ref, F.lit(0.0)))
    pr = _rate(F.col("positive"), F.col("total"))
    di = disparate_impact(pr, F.col("reference_rate"))
    concern = F.col("category").isNotNull() & (F.col("total") > 0) & ((di < DI_THRESHOLD) | (di > 1 / DI_THRESHOLD))
    return t.withColumns({"positive_rate": pr, "di": di, "is_concern": concern,
                          "severity": F.when(di < DI_HIGH_BELOW, F.lit("high")).otherwise(F.lit("medium"))})


def category_metrics(results: DataFrame) -> DataFrame:
    """``(category, total, positive)``; positive = label other than
    Non-Radical."""
    return _table(results).filter(F.col("category").isNotNull()).select("category", "total", "positive")


def concerns(results: DataFrame) -> DataFrame:
    """Categories whose positive rate is below 0.8x or above 1/0.8x the
    overall rate; ``high`` below 0.5x, else ``medium`` (over-representation
    is always medium).  High ones come first."""
    return _table(results).filter("is_concern").select(
        "category",
        round_half_up(F.col("positive_rate"), 4).alias("positive_rate"),
        round_half_up(F.col("reference_rate"), 4).alias("reference_rate"),
        round_half_up(F.col("di"), 4).alias("disparate_impact_ratio"),
        "severity",
    ).orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), "category")


def _score(n_high: Column, n_medium: Column, n_concerns: Column) -> Column:
    pen = (n_high * F.lit(0.3) + n_medium * F.lit(0.1)) / F.greatest(n_concerns, F.lit(1)).cast("double")
    return round_half_up(F.greatest(F.lit(0.0), F.lit(1.0) - pen), 4)


def fairness_score(concern_df: DataFrame, total: Column | None = None) -> DataFrame:
    """``max(0, 1 - (0.3*high + 0.1*medium) / max(1, n))`` (an average
    penalty, so in [0.7, 1]); review needed when any concern is high."""
    a = concern_df.agg(F.count_if(F.col("severity") == "high").alias("n_high"),
                       F.count_if(F.col("severity") == "medium").alias("n_medium"),
                       F.count(F.lit(1)).alias("n_concerns"))
    return a.withColumns({
        "fairness_score": _score(F.col("n_high"), F.col("n_medium"), F.col("n_concerns")),
        "requires_fairness_review": F.col("n_high") > 0,
    })


def summary(results: DataFrame) -> DataFrame:
    """G1 + G4: one row from the one fairness table.  An empty input gives
    zeros and a score of 1.0."""
    allrow = F.col("category").isNull()
    a = _table(results).agg(
        F.coalesce(F.sum(F.when(allrow, F.col("total"))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(allrow, F.col("positive"))), F.lit(0)).alias("flagged_count"),
        F.coalesce(F.sum(F.when(allrow, F.col("bias_count"))), F.lit(0)).alias("bias_risk_count"),
        F.count_if(F.col("is_concern") & (F.col("severity") == "high")).alias("n_high"),
        F.count_if(F.col("is_concern") & (F.col("severity") == "medium")).alias("n_medium"),
        F.count_if("is_concern").alias("n_concerns"))
    return a.select(
        F.col("total").alias("total_processed"), "flagged_count",
        round_half_up(_rate(F.col("flagged_count"), F.col("total")), 4).alias("flagged_rate"),
        "bias_risk_count",
        round_half_up(_rate(F.col("bias_risk_count"), F.col("total")), 4).alias("bias_risk_rate"),
        F.when(F.col("total") == 0, F.lit(1.0)).otherwise(_score(F.col("n_high"), F.col("n_medium"),
                                                                 F.col("n_concerns"))).alias("fairness_score"),
        ((F.col("n_high") > 0) & (F.col("total") > 0)).alias("requires_fairness_review"),
    )


def group_rates(results: DataFrame, group_col: str, reference_group: str) -> DataFrame:
    """G6/G7 by a column (e.g. language): positive rate per group against
    the rate of ``reference_group``.  The grouped table is stored, so the input
    is scanned once, and no task needs all groups."""
    g = results.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(_flagged()).alias("positive"))
    g = materialize(g.withColumn("rate", _rate(F.col("positive"), F.col("n"))))
    ref = g.filter(F.col(group_col) == reference_group).first()
    j = g.withColumn("reference_rate", F.lit(float(ref["rate"]) if ref else 0.0))
    return j.select(
        group_col, "n", "positive",
        round_half_up(F.col("rate"), 4).alias("positive_rate"),
        round_half_up(F.col("reference_rate"), 4).alias("reference_rate"),
        round_half_up(disparate_impact(F.col("rate"), F.col("reference_rate")), 4).alias("disparate_impact_ratio"),
        round_half_up(parity_difference(F.col("rate"), F.col("reference_rate")), 4).alias("parity_difference"),
    )


def odds_by_group(scored: DataFrame, group_col: str, reference_group: str, truth_col: str = "truth",
                  pred_col: str = "pred") -> DataFrame:
    """TPR / FPR per group and the equalized-odds difference to the
    reference group.  ``truth_col`` and ``pred_col`` are 0/1."""
    t, p = F.col(truth_col) == 1, F.col(pred_col) == 1
    g = scored.groupBy(group_col).agg(
        F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"))
    g = materialize(g.withColumns({"tpr": _rate(F.col("tp"), F.col("tp") + F.col("fn")),
                                   "fpr": _rate(F.col("fp"), F.col("fp") + F.col("tn"))}))
    ref = g.filter(F.col(group_col) == reference_group).first()
    j = g.withColumns({f"ref_{c}": F.lit(float(ref[c]) if ref else 0.0) for c in ("tpr", "fpr")})
    return j.select(
        group_col, "tp", "fn", "fp", "tn",
        round_half_up(F.col("tpr"), 4).alias("tpr"), round_half_up(F.col("fpr"), 4).alias("fpr"),
        round_half_up(odds_difference(F.col("tpr"), F.col("ref_tpr"), F.col("fpr"), F.col("ref_fpr")), 4)
        .alias("equalized_odds_difference"),
    )
