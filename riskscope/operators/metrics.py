"""Counters, evaluation metrics and rate limits.

Everything reduces a large frame with a partial aggregate first; the
small per-class / per-label tables that remain (at most k*k rows for k
classes) are then finished in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import LABELS
from .fusion import round_half_up

METRIC_PREFIX = "riskscope"


# --------------------------------------------------------------------------
# G9 / G10 counters
# --------------------------------------------------------------------------

def counters(results: DataFrame, label_col: str = "label", review_col: str = "requires_human_review",
             rejects: DataFrame | None = None, reason_col: str = "reject_reason") -> DataFrame:
    """``(metric, key, value)`` rows: requests, per label, per review
    status and, given a rejects table, errors per reason.  Labels are counted
    as they come (a null label under ``unknown``), so the labels add up to the
    requests.  The input is reduced to one row per (label, review) once."""
    by = results.groupBy(F.coalesce(F.col(label_col).cast("string"), F.lit("unknown")).alias("label"),
                         F.col(review_col).alias("review")).agg(F.count(F.lit(1)).alias("n"))
    review = F.when(F.col("review"), F.lit("review_required")).when(~F.col("review"), F.lit("no_review")).otherwise(
        F.lit("unknown"))
    row = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.alias("key"), F.col("n"))
    parts = by.select(F.explode(F.array(row("requests_total", F.lit("")), row("label_total", F.col("label")),
                                        row("review_total", review))).alias("r")).select("r.*")
    zero = results.sparkSession.createDataFrame([("requests_total", "", 0)], "metric string, key string, n bigint")
    parts = parts.unionByName(zero)
    if rejects is not None:
        parts = parts.unionByName(rejects.groupBy(F.col(reason_col).alias("key")).agg(F.count(F.lit(1)).alias("n"))
                                  .select(F.lit("errors_total").alias("metric"), "key", "n"))
    return parts.groupBy("metric", "key").agg(F.sum("n").cast("bigint").alias("value"))


#: Help text and value label of each counter.
METRIC_HELP: dict[str, tuple[str, str]] = {
    "requests_total": ("Requests classified", ""),
    "label_total": ("Requests by label", "label"),
    "review_total": ("Requests by review status", "status"),
    "errors_total": ("Requests rejected by reason", "reason"),
}


def exposition_lines(counter_df: DataFrame, prefix: str = METRIC_PREFIX) -> DataFrame:
    """``(ord, line)`` text exposition: per metric a HELP and a TYPE line,
    then e.g. ``<prefix>_label_total{label="X"} 5``.  ``ord`` sorts the lines
    (by metric, head lines first, then by key); keys are escaped."""
    name = F.concat(F.lit(prefix + "_"), F.col("metric"))
    pick = lambda j: F.coalesce(*[F.when(F.col("metric") == m, F.lit(v[j])) for m, v in METRIC_HELP.items()], F.lit(""))
    key = F.replace(F.replace(F.replace(F.col("key"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    value = F.concat(F.when(F.col("key") == "", name).otherwise(
        F.concat(name, F.lit("{"), pick(1), F.lit('="'), key, F.lit('"}'))), F.lit(" "), F.col("value").cast("string"))
    lines = counter_df.select("metric", F.lit("2").alias("part"), "key", value.alias("line"))
    heads = counter_df.select("metric").distinct().select("metric", F.explode(F.array(
        F.struct(F.lit("0").alias("part"), F.concat(F.lit("# HELP "), name, F.lit(" "), pick(0)).alias("line")),
        F.struct(F.lit("1").alias("part"), F.concat(F.lit("# TYPE "), name, F.lit(" counter")).alias("line")))).alias("h"))
    heads = heads.select("metric", "h.part", F.lit("").alias("key"), "h.line")
    return lines.unionByName(heads).select(F.concat_ws("|", "metric", "part", "key").alias("ord"), "line")


# --------------------------------------------------------------------------
# G13-G16 evaluation
# --------------------------------------------------------------------------

def confusion(pairs: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred") -> DataFrame:
    """G15 long form ``(y_true, y_pred, n)``."""
    return pairs.groupBy(F.col(true_col).cast("int").alias("y_true"), F.col(pred_col).cast("int").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_dense(pairs: DataFrame, k: int = 4, true_col: str = "y_true", pred_col: str = "y_pred") -> DataFrame:
    """G15 dense form: one row per true class, ``p0..p{k-1}`` and ``p_other``
    counts.  Every class of ``[0, k)`` has a row; truths outside it, and nulls,
    share the row -1."""
    zeros = pairs.sparkSession.range(k).select(F.col("id").cast("int").alias("y_true"), F.lit(-1).alias("y_pred"),
                                               F.lit(0).cast("bigint").alias("n"))
    inside = lambda c: F.when((F.col(c) >= 0) & (F.col(c) < k), F.col(c)).otherwise(F.lit(-1)).alias(c)
    c = confusion(pairs, true_col, pred_col).select(inside("y_true"), inside("y_pred"), "n").unionByName(zeros)
    count = lambda i, name: F.coalesce(F.sum(F.when(F.col("y_pred") == i, F.col("n"))), F.lit(0)).cast("bigint").alias(name)
    return c.groupBy("y_true").agg(*[count(i, f"p{i}") for i in range(k)], count(-1, "p_other"))


def _class_table(pairs: DataFrame, k: int, true_col: str, pred_col: str) -> DataFrame:
    """One row, column ``c``: the k per-class records (label order) with
    tp, fp, fn, precision, recall, f1 and support, and a last one, ``other``
    (-1), for labels outside ``[0, k)`` and nulls if there are any: no pair
    leaves the totals.  Built from the confusion counts in one aggregate, so
    every report below is a single branch over one scan of the input."""
    c = confusion(pairs, true_col, pred_col)
    t, p, n = F.col("y_true"), F.col("y_pred"), F.col("n")
    out_of = lambda x: x.isNull() | (x < 0) | (x >= k)
    right = F.coalesce(t == p, F.lit(False))

    def count(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    sides = [(F.coalesce(t == i, F.lit(False)), F.coalesce(p == i, F.lit(False))) for i in range(k)] + [(out_of(t), out_of(p))]
    stats = c.agg(*[a for i, (is_t, is_p) in enumerate(sides) for a in (
        count(is_t & is_p & right).alias(f"tp{i}"), count(is_p & ~right).alias(f"fp{i}"),
        count(is_t & ~right).alias(f"fn{i}"))])
    names = [(i, LABELS[i] if i < len(LABELS) else str(i)) for i in range(k)] + [(-1, "other")]
    raw = F.array(*[F.struct(F.lit(label).alias("label_id"), F.lit(name).alias("label"),
                             F.col(f"tp{i}").cast("bigint").alias("tp"), F.col(f"fp{i}").cast("bigint").alias("fp"),
                             F.col(f"fn{i}").cast("bigint").alias("fn")) for i, (label, name) in enumerate(names)])
    raw = F.filter(raw, lambda x: (x["label_id"] >= 0) | (x["tp"] + x["fp"] + x["fn"] > 0))

    def finish(x):
        prec = F.when(x["tp"] + x["fp"] == 0, F.lit(0.0)).otherwise(x["tp"] / (x["tp"] + x["fp"]))
        rec = F.when(x["tp"] + x["fn"] == 0, F.lit(0.0)).otherwise(x["tp"] / (x["tp"] + x["fn"]))
        return F.struct(x["label_id"].alias("label_id"), x["label"].alias("label"), x["tp"].alias("tp"),
                        prec.cast("double").alias("precision"), rec.cast("double").alias("recall"),
                        (x["tp"] + x["fn"]).alias("support"))

    def add_f1(x):
        pr, rc = x["precision"], x["recall"]
        f1 = F.when(pr + rc == 0, F.lit(0.0)).otherwise(F.lit(2.0) * pr * rc / (pr + rc))
        return F.struct(x["label_id"].alias("label_id"), x["label"].alias("label"), x["tp"].alias("tp"),
                        pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), x["support"].alias("support"))

    return stats.select(F.transform(F.transform(raw, finish), add_f1).alias("c"))


def per_class(pairs: DataFrame, k: int = 4, true_col: str = "y_true", pred_col: str = "y_pred") -> DataFrame:
    """``(label_id, label, precision, recall, f1, support)`` for every
    class of the label dimension, zero-filled (a class absent from the data
    still gets its row; zero division gives 0)."""
    return (_class_table(pairs, k, true_col, pred_col).select(F.explode("c").alias("s"))
            .select("s.label_id", "s.label", "s.precision", "s.recall", "s.f1", "s.support"))


def _sums(digits: int, k: int):
    n = F.aggregate("c", F.lit(0).cast("bigint"), lambda acc, x: acc + x["support"])

    def wsum(field):
        return F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x[field] * x["support"].cast("double"))

    def msum(field):
        return F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x[field])

    def div(x, d):
        return round_half_up(F.when(d == 0, F.lit(0.0)).otherwise(x / d.cast("double")), digits)

    tp = F.aggregate("c", F.lit(0).cast("bigint"), lambda acc, x: acc + x["tp"])
    return n, tp, wsum, msum, div


def eval_metrics(pairs: DataFrame, k: int = 4, true_col: str = "y_true", pred_col: str = "y_pred",
                 digits: int = 6) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 (one row).
    Sums run over the k per-class records in label order, so the float
    result does not depend on partitioning."""
    n, tp, wsum, _msum, div = _sums(digits, k)
    return _class_table(pairs, k, true_col, pred_col).select(
        div(tp.cast("double"), n).alias("accuracy"), div(wsum("precision"), n).alias("precision"),
        div(wsum("recall"), n).alias("recall"), div(wsum("f1"), n).alias("f1"), n.alias("support"))


def eval_report(pairs: DataFrame, k: int = 4, true_col: str = "y_true", pred_col: str = "y_pred",
                digits: int = 6) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and
    ``weighted avg`` rows, each with its support (one branch, exploded)."""
    n, _tp, wsum, msum, div = _sums(digits, k)
    kk = F.size("c").cast("bigint")

    def row(name, p, r, f, sup):
        return F.struct(name.alias("row"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f.cast("double").alias("f1"), sup.cast("bigint").alias("support"))

    per = F.transform("c", lambda x: row(x["label"], round_half_up(x["precision"], digits),
                                         round_half_up(x["recall"], digits), round_half_up(x["f1"], digits),
                                         x["support"]))
    tail = F.array(
        row(F.lit("accuracy"), F.lit(None), F.lit(None), div(wsum("recall"), n), n),
        row(F.lit("macro avg"), div(msum("precision"), kk), div(msum("recall"), kk), div(msum("f1"), kk), n),
        row(F.lit("weighted avg"), div(wsum("precision"), n), div(wsum("recall"), n), div(wsum("f1"), n), n))
    return (_class_table(pairs, k, true_col, pred_col).select(F.explode(F.concat(per, tail)).alias("r"))
            .select("r.*"))


# --------------------------------------------------------------------------
# G17 batch stats
# --------------------------------------------------------------------------

def batch_stats(df: DataFrame, batch_col: str = "batch_id", reason_col: str = "reject_reason") -> DataFrame:
    """G17 counts per batch: ``total, processed, failed`` (timing comes from
    the driver: see ``plans.classify`` callers)."""
    return df.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(reason_col).isNull()).alias("processed"),
        F.count_if(F.col(reason_col).isNotNull()).alias("failed"))


# --------------------------------------------------------------------------
# T5 batch form: rate-limit flags
# --------------------------------------------------------------------------

def over_limit(counts: DataFrame, limit: int | dict[str, int], kind_col: str | None = None) -> DataFrame:
    """The counts ``n`` above the limit.  Limits by kind come as a dict; a kind
    that is not in it, or null, has no limit."""
    if isinstance(limit, dict):
        of_kind = F.create_map(*[F.lit(x) for pair in limit.items() for x in pair])
        return counts.filter(F.col("n") > F.try_element_at(of_kind, F.col(kind_col))) if limit else counts.limit(0)
    return counts.filter(F.col("n") > limit)


def rate_limit_flags(events: DataFrame, client_col: str, ts_col: str, window: str, limit: int | dict[str, int],
                     kind_col: str | None = None) -> DataFrame:
    """Clients over ``limit`` requests in an epoch-aligned tumbling window:
    ``(window_start, client, n)``, with ``kind_col`` counted and limited by kind
    (``params.RATE_LIMITS``).  Partial aggregation per (window, client, kind)."""
    keys = [client_col] + ([kind_col] if kind_col else [])
    g = events.groupBy(F.window(ts_col, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return over_limit(g, limit, kind_col).select(F.col("w.start").alias("window_start"), *keys, "n")
