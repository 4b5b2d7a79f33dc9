"""Structured Streaming forms of the service state.

The original keeps running counters and rate limits in process memory.  Here each is a streaming query with its state in Spark's
state store (checkpointed, so it survives executor loss):

* T1 ``classify_stream``: stateless classification, append to files.
* T2 ``label_counts_stream``: counts per (event-time window, label), with a
  watermark so old windows' state is dropped.
* T3 ``category_counts_stream``: running counts per sensitive category.
* T5 ``rate_limit_stream``: requests per client per window.
* T6 ``ingest_stream``: ``foreachBatch`` writes normalised valid rows and
  rejects from one persisted micro-batch.

Every job takes its checkpoint location, one per output: called again with the
same pair, it goes on where it stopped, with its state and its batch numbers.

Aggregations run in ``update`` mode into a compacted upsert log (see
``upsert_batch``); ``latest`` reads the newest version of each key.  That keeps
the sink idempotent per batch id and works with ``availableNow`` triggers,
where the last windows would never be emitted in ``append`` mode.

Spark drops rows behind the watermark without a trace.  With ``late_out``, T2
and T5 part the stream first (``part_late``): late rows go to that table, the
others to the counts, so counts plus late rows equal the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset as D
from ..operators import validation as V
from ..plans.classify import classify
from ..session import checkpoint_dir, scratch_path

FAN = 10  # runs of an upsert log that are folded into one of the next level


def folder_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over the Parquet files that arrive in a folder; all that
    have arrived go into one micro-batch unless a limit is given."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def _run(writer, checkpoint: str) -> None:
    """Work off what has arrived since the last call with this checkpoint."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _batch_dir(out: str, batch_id: int) -> str:
    """Each micro-batch owns one directory and overwrites it, so a batch
    that is re-run after a failure replaces its output instead of adding
    duplicates (idempotent ``foreachBatch``)."""
    return f"{out.rstrip('/')}/batch_id={batch_id}"


def write_batch(batch: DataFrame, out: str, batch_id: int) -> None:
    """Write one micro-batch to its own directory (replaced on a re-run)."""
    batch.write.mode("overwrite").parquet(_batch_dir(out, batch_id))


def _log_run(out: str, level: int, run: int, fan: int) -> str:
    return f"{out.rstrip('/')}/log_level={level}/log_slot={run % (2 * fan)}"


def _newest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key with the largest ``batch_id``, which stays a column."""
    cols = [c for c in log.columns if c not in (*keys, "log_level", "log_slot")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("__v"))
    return last.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in cols])


def upsert_batch(batch: DataFrame, out: str, keys: list[str], batch_id: int, fan: int = FAN) -> None:
    """Add the new rows of some keys to a log that stays small.

    Batch n is run n of level 0.  Every ``fan`` runs of a level are folded, the
    newest row of a key staying, into one run of the next level, so a row is
    written again only once a level, and 1,000 batches leave at most 2 ``fan``
    folders in each of 4 levels.  A level keeps its last 2 ``fan`` runs: a run is
    written over another only when that one has long been folded.  What is left of
    folded runs holds older rows of the same keys, or equal ones, so readers need no
    list of the valid runs, and a batch that died between any two steps is just
    run again."""
    batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(_log_run(out, 0, batch_id, fan))
    level, run = 0, batch_id
    while (run + 1) % fan == 0:
        runs = [_log_run(out, level, r, fan) for r in range(run + 1 - fan, run + 1)]
        level, run = level + 1, (run + 1) // fan - 1
        _newest(batch.sparkSession.read.parquet(*runs), keys).write.mode("overwrite").parquet(_log_run(out, level, run, fan))


def _upsert_sink(df: DataFrame, out: str, keys: list[str]):
    return df.writeStream.outputMode("update").foreachBatch(lambda b, i: upsert_batch(b, out, keys, i))


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest version of every key in an upsert log."""
    return _newest(spark.read.parquet(out), keys).drop("batch_id")


def part_late(stream: DataFrame, ts_col: str, window: str, delay: str, late_out: str, work: str) -> DataFrame:
    """Work off ``stream`` into the rows in time, returned as a stream, and the
    late ones, appended to ``late_out`` with ``late_reason`` and ``watermark``.

    The watermark of a batch is the largest event time of all batches before it
    less ``delay``; a row is ``late`` when its window has ended by then, and
    ``no_time`` without an event time.  The batch's largest event time is kept
    under ``work`` in one of two places by turns, so a batch that is run again
    finds its predecessor's.  Windowed counts over the returned stream see whole
    batches of this one and the same delay, so their own watermark is never ahead
    of this one and drops nothing.  Files of rows in time go once they are worked
    off.  ``late_reason`` and ``watermark`` must not be columns of the stream."""
    if {"late_reason", "watermark"} & set(stream.columns):
        raise ValueError("late_reason and watermark are added to late rows: rename those columns")
    in_time, marks = f"{work}/in_time", f"{work}/marks"

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        seen = session.read.parquet(f"{marks}/slot={(batch_id - 1) % 2}").first()["seen"] if batch_id else None
        rows = batch.persist()
        try:
            mark = F.timestamp_micros(F.lit(seen).cast("long")) - F.expr(f"interval {delay}")
            reason = (F.when(F.col(ts_col).isNull(), F.lit("no_time"))
                      .when(F.window(F.col(ts_col), window)["end"] <= mark, F.lit("late")))
            # a window over a null time drops the row, so such rows are told apart before
            timed = rows.filter(F.col(ts_col).isNotNull()).withColumn("late_reason", reason)
            untimed = rows.filter(F.col(ts_col).isNull()).withColumn("late_reason", F.lit("no_time"))
            late = timed.filter(F.col("late_reason").isNotNull()).unionByName(untimed).withColumn("watermark", mark)
            write_batch(late, late_out, batch_id)
            write_batch(timed.filter(F.col("late_reason").isNull()).drop("late_reason"), in_time, batch_id)
            newest = rows.agg(F.max(F.unix_micros(ts_col)).alias("seen")).select(
                F.greatest("seen", F.lit(seen).cast("long")).alias("seen"))
            newest.write.mode("overwrite").parquet(f"{marks}/slot={batch_id % 2}")
        finally:
            rows.unpersist()

    _run(stream.writeStream.foreachBatch(write), f"{work}/checkpoint")
    return stream.sparkSession.readStream.schema(stream.schema).option("cleanSource", "delete").parquet(in_time)


# --------------------------------------------------------------------------
# T1
# --------------------------------------------------------------------------

def classify_stream(stream: DataFrame, out: str, checkpoint: str, **classify_kw) -> None:
    """Classify arriving rows, append them to parquet files at ``out``."""
    res = classify(stream, **classify_kw)
    _run(res.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)


# --------------------------------------------------------------------------
# T2, T3, T5 windowed / keyed counters
# --------------------------------------------------------------------------

def _windowed_counts(rows: DataFrame, ts_col: str, window: str, watermark: str, keys: list[str], out: str,
                     checkpoint: str, late_out: str | None) -> None:
    if late_out:
        rows = part_late(rows, ts_col, window, watermark, late_out, f"{checkpoint}/parted")
        checkpoint = f"{checkpoint}/counted"
    agg = (rows.withWatermark(ts_col, watermark).groupBy(F.window(ts_col, window).alias("w"), *keys)
           .agg(F.count(F.lit(1)).alias("n"))
           .select(F.col("w.start").alias("window_start"), *keys, "n"))
    _run(_upsert_sink(agg, out, ["window_start", *keys]), checkpoint)


def label_counts_stream(results: DataFrame, ts_col: str, window: str, watermark: str, out: str,
                        checkpoint: str, late_out: str | None = None) -> None:
    """``(window_start, label, review, n)`` per event-time window.  Rows whose
    window has ended before the watermark are not counted (nor rows without an
    event time); with ``late_out`` they are kept there."""
    _windowed_counts(results, ts_col, window, watermark, ["label", "requires_human_review"], out, checkpoint, late_out)


def category_counts_stream(results: DataFrame, out: str, checkpoint: str) -> None:
    """Running ``(category, total, positive)``; state is one row per
    category (a handful)."""
    agg = (results.select(F.explode("bias_metadata.detected_categories").alias("category"),
                          (F.col("label") != "Non-Radical").alias("pos"))
           .groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("pos").alias("positive")))
    _run(_upsert_sink(agg, out, ["category"]), checkpoint)


def rate_limit_stream(events: DataFrame, client_col: str, ts_col: str, window: str, watermark: str,
                      out: str, checkpoint: str, kind_col: str | None = None, late_out: str | None = None) -> None:
    """T5: requests per client, and per kind where a column names it, in each
    epoch-aligned tumbling window; ``metrics.over_limit`` on the latest counts
    gives the flags.  Rows behind the watermark as in T2."""
    keys = [client_col] + ([kind_col] if kind_col else [])
    _windowed_counts(events, ts_col, window, watermark, keys, out, checkpoint, late_out)


# --------------------------------------------------------------------------
# T6 ingest
# --------------------------------------------------------------------------

def ingest_stream(stream: DataFrame, text_col: str, valid_out: str, rejects_out: str, checkpoint: str,
                  max_text_chars: int | None = None) -> None:
    """Each micro-batch is persisted once; its rejects (with the reason) and
    its valid rows, normalised as by B6 (stripped, optionally truncated), go to
    two outputs."""
    def write(batch: DataFrame, batch_id: int) -> None:
        b = V.reject_single(batch, text_col).persist()
        try:
            valid, _ = D.normalize(b.filter(F.col("reject_reason").isNull()).drop("reject_reason"), text_col,
                                   max_text_chars=max_text_chars)
            write_batch(valid, valid_out, batch_id)
            write_batch(b.filter(F.col("reject_reason").isNotNull()), rejects_out, batch_id)
        finally:
            b.unpersist()
    _run(stream.writeStream.foreachBatch(write), checkpoint)


def fresh_dir(spark: SparkSession, name: str) -> str:
    checkpoint_dir(spark)
    return scratch_path(spark, name)
