"""Classifier scoring (E1-E7), re-aimed as distributed scoring.

The model itself is a plug-in.  Scores arrive either as an in-row
``array<double>`` of class probabilities (no shuffle), as a keyed scores
table (one join on the key), as logits (``score_logits``), or from any
Python model run once per task over Arrow batches (``score_with_model``).
Everything after the probabilities is native expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import FALLBACK_PROBS, LABELS
from ..session import scratch_path
from .membership import FILTER_BYTES, cascade, key_pair


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def labels_array() -> Column:
    return F.array(*[F.lit(x) for x in LABELS])


def label_name(label_id: str | Column) -> Column:
    """Label id (0-based) to its name."""
    return F.element_at(labels_array(), _col(label_id) + 1)


def argmax(probs: str | Column) -> Column:
    """0-based index of the largest value; the first one wins on ties."""
    p = _col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def softmax(logits: str | Column) -> Column:
    """Numerically safe softmax of an ``array<double>``."""
    x = _col(logits).cast("array<double>")
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def score_logits(df: DataFrame, logits_col: str = "logits", prefix: str = "ml_") -> DataFrame:
    """Logits to probabilities, label id (argmax, first wins), label and
    confidence (the largest probability)."""
    df = df.withColumn(f"{prefix}probs", softmax(logits_col))
    return _derive(df, prefix)


def _derive(df: DataFrame, prefix: str) -> DataFrame:
    p = F.col(f"{prefix}probs")
    df = df.withColumn(f"{prefix}label_id", argmax(p))
    return df.withColumns({
        f"{prefix}label": label_name(f"{prefix}label_id"),
        f"{prefix}confidence": F.array_max(p),
    })


def score_probs(df: DataFrame, probs_col: str = "probs", prefix: str = "ml_") -> DataFrame:
    """Attach model fields from a probability array; a null array (no
    model result for the row) falls back to the fixed score and sets
    ``ml_missing``."""
    fallback = F.array(*[F.lit(float(v)) for v in FALLBACK_PROBS])
    df = df.withColumns({
        f"{prefix}missing": F.col(probs_col).isNull(),
        f"{prefix}probs": F.coalesce(F.col(probs_col).cast("array<double>"), fallback),
    })
    return _derive(df, prefix)


def probabilities_map(probs: str | Column) -> Column:
    """``map<label, probability>``."""
    return F.map_from_arrays(labels_array(), _col(probs))


def fine_grained_scores(df: DataFrame, key: str = "doc_id", probs_col: str = "ml_probs") -> DataFrame:
    """Long form ``(key, label_id, prob)``."""
    return df.select(F.col(key), F.posexplode(probs_col).alias("label_id", "prob")).withColumn(
        "label_id", F.col("label_id").cast("int"))


def attach_scores(df: DataFrame, scores: DataFrame, key: str = "doc_id", probs_col: str = "probs") -> DataFrame:
    """Left-join a keyed scores table ``(key, probs)``.  Rows without a score
    keep a null ``probs`` and take the fallback in ``score_probs``.  The
    join shuffles both sides on the key (or broadcasts a small side when
    AQE measures it small); AQE splits skewed partitions."""
    return df.join(scores.select(key, probs_col), key, "left")


def score_distinct(df: DataFrame, text_col: str, scorer: Callable[[DataFrame], DataFrame],
                   probs_col: str = "probs", key: str = "doc_id", max_filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Score every distinct text once; adds ``probs_col`` to every row.

    ``scorer`` maps a frame to the same frame plus ``probs_col``; it must depend
    on ``text_col`` alone.  ``key`` need not be unique and may be null.

    A text is known by its SHA-256 digest.  Digests are counted on a narrow
    table; exact filters (``membership.cascade``) of the digests that occur
    twice and of each one's first key go to the tasks.  A text that occurs once
    is scored where it is, a repeated one where it has its first key, and only
    (digest, probs) meets the other repeats.  So the operator moves no text: of
    repeated rows the join takes the columns that its user reads.  Rows that
    share their text's first key too are each scored.  Where the filters would
    outgrow ``max_filter_bytes``, first keys join the rows instead.
    """
    spark = df.sparkSession
    h, k = F.coalesce(F.sha2(F.col(text_col), 256), F.lit("")), F.col(key).cast("string")
    path = scratch_path(spark, "digests")
    # The filters know a text by two cheap hashes of it: tasks test every row.
    ab = key_pair(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())
    df.select(h.alias("h"), k.alias("k"), *ab).write.parquet(path)
    digests = spark.read.parquet(path)
    path = scratch_path(spark, "digest-groups")
    (digests.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k")).alias("first"), F.first("a").alias("a"),
                              F.first("b").alias("b"))
     .select("h", "n", "a", "b", F.col("first.k").alias("first")).write.parquet(path))
    groups = spark.read.parquet(path)
    twice = groups.where("n > 1")
    if twice.isEmpty():
        return scorer(df)
    pair = lambda a, b, c: key_pair(F.col(a), F.col(b), F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")))
    later = digests.join(twice.select("h", "first"), "h").where(~F.col("k").eqNullSafe(F.col("first"))).select("a", "b", "k").distinct()
    cols = df.columns
    rows = df.withColumns({"__h": h, "__k": k, "__a": ab[0], "__b": ab[1]})
    repeated = cascade(twice.select("a", "b"), groups.where("n = 1").select("a", "b"), max_filter_bytes)
    leading = repeated and cascade(twice.select(*pair("a", "b", "first")), later.select(*pair("a", "b", "k")), max_filter_bytes)
    if leading:
        rows = rows.withColumn("__twice", repeated.test(spark, F.col("__a"), F.col("__b")))
        rows = rows.withColumn("__lead", F.col("__twice") & leading.test(spark, *pair("__a", "__b", "__k")))
    else:
        known = groups.select(F.col("h").alias("__h"), (F.col("n") > 1).alias("__twice"), "first")
        rows = rows.join(known, "__h").withColumn("__lead", F.col("__twice") & F.col("first").eqNullSafe(F.col("__k"))).drop("first")
    alone = scorer(rows.where("not __twice").select(*cols))
    scores = (scorer(rows.where("__lead")).select("__h", probs_col).groupBy("__h")
              .agg(F.first(probs_col).alias(probs_col)))
    shared = rows.where("__twice").select(*cols, "__h").join(scores, "__h")
    return alone.select(*cols, probs_col).unionByName(shared.select(*cols, probs_col))


#: Bytes of text that a plug-in model gets at once.
MODEL_BYTES = 2 << 20


def _slices(texts, limit: int) -> Iterator:
    """An Arrow array of strings in slices of about ``limit`` bytes, a text at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="int64")
    start = 0
    while start < len(texts):
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def score_with_model(df: DataFrame, text_col: str, load_model: Callable[[], Callable], n_labels: int = 4,
                     out_col: str = "probs", max_bytes: int = MODEL_BYTES) -> DataFrame:
    """E6 plug-in point: run any Python model over Arrow batches.

    ``load_model()`` is called once per task and must return a function
    ``texts: pandas.Series -> numpy array (n, n_labels)`` of logits.  Only the
    texts go to Python, in Arrow record batches
    (``spark.sql.execution.arrow.maxRecordsPerBatch``), and only the logits come
    back; the model gets a batch in slices of about ``max_bytes`` of text, so a
    task holds objects for a slice and never for a batch.  Softmax and the label
    fields stay native in ``score_logits``.  ``load_model`` travels to the
    executors with the task: define it in an installed module, locally, or in a
    module registered with ``cloudpickle.register_pickle_by_value``; load weights
    from shared storage inside it.
    """
    import numpy as np

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = load_model()
        for texts in batches:
            logits = [np.zeros((0, n_labels))]
            for part in _slices(texts, max_bytes):
                series = part.to_pandas().rename(text_col)
                logits.append(np.asarray(predict(series), dtype="float64").reshape(len(part), n_labels))
            flat = pa.array(np.concatenate(logits).ravel(), from_pandas=True)  # a logit that is no number is null
            yield pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, n_labels, dtype="int32"), flat)

    # Not deterministic: a filter above is not pushed below it, so no text is scored twice.
    model = F.arrow_udf(run, T.ArrayType(T.DoubleType())).asNondeterministic()
    out = df.withColumn("__logits", model(F.col(text_col).cast("string")))
    return out.withColumn(out_col, softmax("__logits")).drop("__logits")
