"""Input validation (B1-B5) as reject reasons instead of exceptions.

Invalid rows are not errors of the job: they get a ``reject_reason`` and go
to a rejects table, valid rows go on.  Frame-level checks are a single
aggregate over the frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ustrip
from ..params import MAX_API_BATCH_TEXTS, MAX_BATCH_TEXTS, MAX_INPUT_CHARS
from ..sources.io import require_columns


def single_reject_reason(text_col: str = "text"):
    """B1: ``empty`` (null or ''), ``blank`` (only whitespace), else null."""
    t = F.col(text_col)
    return (F.when(t.isNull() | (t == ""), F.lit("empty"))
            .when(ustrip(t) == "", F.lit("blank")))


def reject_single(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("reject_reason", single_reject_reason(text_col))


def batch_verdicts(df: DataFrame, batch_col: str = "batch_id", idx_col: str = "item_idx", text_col: str = "text",
                   max_batch: int = MAX_BATCH_TEXTS) -> DataFrame:
    """B2: one row per batch: size, first empty item index, verdict
    (``batch_too_large`` / ``empty_item`` / null).  Whitespace-only items
    pass here, as in the original batch check.  Partial aggregation: a batch
    holding a third of all rows is reduced map-side to one row per task."""
    t = F.col(text_col)
    return (df.groupBy(batch_col)
            .agg(F.count(F.lit(1)).alias("batch_size"),
                 F.min(F.when(t.isNull() | (t == ""), F.col(idx_col))).alias("first_empty_idx"))
            .withColumn("verdict", F.when(F.col("batch_size") > max_batch, F.lit("batch_too_large"))
                        .when(F.col("first_empty_idx").isNotNull(), F.lit("empty_item"))))


def strict_reject_reason(text_col: str = "text", max_chars: int = MAX_INPUT_CHARS):
    """B3 per-item reasons of the strict (service) profile."""
    t = F.col(text_col)
    return (F.when(t.isNull() | (t == ""), F.lit("empty"))
            .when(F.length(t) > max_chars, F.lit("too_long"))
            .when(ustrip(t) == "", F.lit("blank")))


def reject_strict(df: DataFrame, batch_col: str = "batch_id", text_col: str = "text",
                  max_chars: int = MAX_INPUT_CHARS, max_batch: int = MAX_API_BATCH_TEXTS) -> DataFrame:
    """Item reasons plus ``batch_too_large`` for batches over
    ``max_batch`` items and ``no_batch`` for items without a batch.  Only the
    keys of the large batches are joined back, so texts move only if there are
    too many of those to broadcast."""
    sizes = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("__n"))
    large = sizes.where((F.col("__n") > max_batch) & F.col(batch_col).isNotNull()).select(
        batch_col, F.lit(True).alias("__large"))
    out = df.join(large, batch_col, "left").withColumn(
        "reject_reason", F.when(F.col(batch_col).isNull(), F.lit("no_batch"))
        .when(F.col("__large"), F.lit("batch_too_large"))
        .otherwise(strict_reject_reason(text_col, max_chars)))
    return out.drop("__large")


def _label_number(label_col: str):
    """The label as a number; null for text that is none."""
    return F.col(label_col).cast("string").try_cast("double")


def frame_summary(df: DataFrame, num_labels: int = 4, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """The counting part of B5 as one aggregate (one pass): ``rows,
    null_text, null_label, non_integer_labels, out_of_range``.  Jobs check
    this first and compute ``frame_checks`` details only on failure."""
    require_columns(df, (text_col, label_col))
    lab = _label_number(label_col)
    integral = lab.isNotNull() & (lab == F.floor(lab))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(text_col).isNull()).alias("null_text"),
        F.count_if(F.col(label_col).isNull()).alias("null_label"),
        F.count_if(F.col(label_col).isNotNull() & ~integral).alias("non_integer_labels"),
        F.count_if(integral & ((lab < 0) | (lab >= num_labels))).alias("out_of_range"),
    )


def bad_label_values(df: DataFrame, num_labels: int = 4, label_col: str = "label") -> DataFrame:
    """Every label value that is no class index, as ``(value, n)``."""
    lab = _label_number(label_col)
    good = (lab == F.floor(lab)) & (lab >= 0) & (lab < num_labels)
    bad = df.filter(F.col(label_col).isNotNull() & ~F.coalesce(good, F.lit(False)))
    return bad.groupBy(F.col(label_col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def frame_checks(df: DataFrame, key: str, num_labels: int = 4, text_col: str = "text", label_col: str = "label",
                 first_n: int = 15) -> DataFrame:
    """One summary row.  Required columns are checked on the schema
    (raises).  One aggregate counts null text, null labels, non-integral labels
    and out-of-range labels; the first ``first_n`` keys of each null kind come
    from a bounded top-k (``orderBy + limit`` keeps ``first_n`` rows per task).
    The offending values are a table of their own: ``bad_label_values``."""
    require_columns(df, (text_col, label_col))
    lab = _label_number(label_col)
    integral = lab.isNotNull() & (lab == F.floor(lab))
    bad_range = integral & ((lab < 0) | (lab >= num_labels))
    summary = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(text_col).isNull()).alias("null_text"),
        F.count_if(F.col(label_col).isNull()).alias("null_label"),
        F.count_if(F.col(label_col).isNotNull() & ~integral).alias("non_integer_labels"),
        F.count_if(bad_range).alias("out_of_range"),
    )
    def first_keys(cond, name):
        top = df.filter(cond).select(F.col(key)).orderBy(key).limit(first_n)
        return top.agg(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("bigint"))), ",").alias(name))

    a = first_keys(F.col(text_col).isNull(), "first_null_text_keys")
    b = first_keys(F.col(label_col).isNull(), "first_null_label_keys")
    one = F.lit(1)
    out = (summary.withColumn("__k", one).join(a.withColumn("__k", one), "__k").join(b.withColumn("__k", one), "__k").drop("__k"))
    return out.withColumn("valid", (F.col("null_text") == 0) & (F.col("null_label") == 0)
                          & (F.col("non_integer_labels") == 0) & (F.col("out_of_range") == 0))
