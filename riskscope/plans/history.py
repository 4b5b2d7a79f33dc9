"""Category history of the fairness monitor (G5), kept from run to run.

A run adds one record with its mergeable counts, a reset adds a marker; nothing
is changed in place.  Reading sums the last record of each run since the last
reset, so no result row is read again, and a run that is repeated under its id
replaces itself.  A record is one file of one line, so it is there whole or not
at all.  Records are ordered by the time at which they were written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fairness import category_counts
from ..sources.io import write_json

_COUNTS = "array<struct<category: string, total: bigint, positive: bigint>>"
_RECORD = f"run_id string, written_at double, counts {_COUNTS}"


def _add(record: DataFrame, path: str) -> None:
    write_json(record.withColumn("written_at", F.current_timestamp().cast("double")), path, mode="append")


def record(results: DataFrame, path: str, run_id: str | None = None) -> str:
    """Add the counts of one run's results (``label``, ``bias_metadata``);
    returns the run's id.  Results without a row count as a run of nothing."""
    run = run_id or f"r-{uuid.uuid4().hex}"
    counts = category_counts(results).select(F.struct("category", "total", "positive").alias("c"))  # a row a category
    _add(counts.agg(F.collect_list("c").alias("counts")).withColumn("run_id", F.lit(run)), path)
    return run


def reset(spark: SparkSession, path: str) -> None:
    """Runs recorded so far no longer count; a run that is recorded again does."""
    _add(spark.range(1).select(F.lit(None).cast("string").alias("run_id")), path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """``(category, total, positive)`` over all runs since the last reset; the
    row without a category counts all results.  No rows if nothing was
    recorded since."""
    records = spark.read.schema(_RECORD).json(path)
    last_reset = records.filter(F.col("run_id").isNull()).agg(F.max("written_at").alias("reset_at"))  # one row
    since = records.filter(F.col("run_id").isNotNull()).join(F.broadcast(last_reset)).filter(
        F.col("reset_at").isNull() | (F.col("written_at") > F.col("reset_at")))
    runs = since.groupBy("run_id").agg(F.max_by("counts", "written_at").alias("counts"))
    return (runs.select(F.inline("counts")).groupBy("category")
            .agg(F.sum("total").alias("total"), F.sum("positive").alias("positive")))
