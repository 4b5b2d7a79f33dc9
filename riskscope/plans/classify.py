"""End-to-end classification (I1-I5) and its projections.

``classify`` is one narrow job: truncate -> clean -> rules -> scores ->
fuse.  With in-row scores there is no shuffle at all; with a keyed scores
table there is one join on the key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, tokenize, truncate
from ..operators.fusion import fuse
from ..operators.rules import match_rules
from ..operators.scoring import probabilities_map, score_probs
from ..params import CHUNK_SIZE, DEFAULT_FUSION, DEFAULT_LEXICON, FusionParams, Lexicon
from ..session import scratch_path


def classify(df: DataFrame, text_col: str = "text", probs_col: str = "probs",
             lexicon: Lexicon = DEFAULT_LEXICON, params: FusionParams = DEFAULT_FUSION,
             max_chars: int | None = None, guarded: bool = True) -> DataFrame:
    """I1.  ``df`` holds ``text_col`` and ``probs_col`` (model probabilities,
    null = no model result).  Rules see the cleaned text; the model score
    belongs to the raw text.  Adds ``input``, ``was_truncated``, ``cleaned``,
    rule, model and fused columns.

    Whole texts are processed by default.  ``max_chars`` applies the
    original service's input cut (B4, ``MAX_INPUT_CHARS`` = 10,000 code
    points) first, for callers that want that behaviour."""
    if probs_col not in df.columns:  # no model attached: every row takes the fallback score
        df = df.withColumn(probs_col, F.lit(None).cast("array<double>"))
    if max_chars:
        df = df.withColumns({"input": truncate(text_col, max_chars),
                             "was_truncated": F.length(text_col) > max_chars})
    else:
        df = df.withColumns({"input": F.col(text_col), "was_truncated": F.lit(False)})
    df = df.withColumn("cleaned", clean("input", guarded))
    df = match_rules(df, "cleaned", lexicon)
    df = score_probs(df, probs_col)
    return fuse(df, params)


def result_view(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The 12-field result, minus the non-deterministic stamp and id
    (see ``with_audit_fields``)."""
    return df.select(key, "input", "label", "confidence", "risk_score", "flagged_terms", "requires_human_review",
                     "bias_metadata", "reasoning", "rule_amplification")


def stored_results(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result fields (all that ``result_view``, ``audit_view``, ``csv_view``
    and ``write_logs`` read), written once to the shared scratch folder: a job
    that writes several outputs from them classifies once."""
    spark = df.sparkSession
    path, res = scratch_path(spark, "results"), result_view(df, key)
    res.write.parquet(path)
    return spark.read.schema(res.schema).parquet(path)


def with_audit_fields(df: DataFrame, key: str = "doc_id", request_col: str | None = None) -> DataFrame:
    """The request id (a column's, else the key), a processing stamp and a
    random audit id per row."""
    request = F.col(request_col) if request_col else F.col(key)
    return df.withColumns({"request_id": request.cast("string"), "processed_at": F.current_timestamp(),
                           "audit_id": F.expr("uuid()")})


def flat_result(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Checked projection: nested fields flattened to strings."""
    factors = F.array_join(F.transform("bias_metadata.risk_factors",
                                       lambda f: F.concat(f["category"], F.lit("="), F.array_join(f["terms"], "|"))), ";")
    return df.select(
        key,
        F.length("input").alias("input_chars"),
        "was_truncated", "label", "confidence", "risk_score",
        F.array_join("flagged_terms", ", ").alias("flagged_terms"),
        "requires_human_review",
        F.col("bias_metadata.high_bias_risk").alias("bias_risk"),
        F.array_join("bias_metadata.detected_categories", ",").alias("bias_categories"),
        factors.alias("bias_terms"),
        F.array_join("review_reasons", ",").alias("review_reasons"),
        "reasoning", "rule_amplification",
    )


def raw_view(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The intermediates nested under ``raw``."""
    toks = tokenize("cleaned")
    return df.select(key, F.struct(
        F.struct(F.col("input").alias("original"), F.col("cleaned").alias("cleaned"), toks.alias("tokens"),
                 F.size(toks).alias("token_count")).alias("preprocessed"),
        F.struct(F.col("rule_flagged").alias("flagged"), F.col("rule_terms").alias("matched_terms"),
                 F.col("rule_risk").alias("risk_score"), F.col("kw_by_severity").alias("keyword_details"),
                 F.col("pattern_hits").alias("pattern_details"),
                 F.col("has_high_risk").alias("has_high_risk_terms")).alias("rule_result"),
        F.struct(F.col("ml_label").alias("label"), F.col("ml_label_id").alias("label_id"),
                 F.col("ml_confidence").alias("confidence"),
                 probabilities_map("ml_probs").alias("probabilities")).alias("ml_result"),
    ).alias("raw"))


def audit_view(df: DataFrame, key: str = "doc_id", request_col: str | None = None) -> DataFrame:
    """The 8-field audit record plus a log preview of the input (first
    100 characters, ``...`` when longer)."""
    req = F.col(request_col) if request_col else F.col(key).cast("string")
    return df.select(
        key,
        req.alias("request_id"),
        "label", "risk_score", "confidence", "requires_human_review",
        F.col("bias_metadata.high_bias_risk").alias("bias_risk"),
        F.when(F.length("input") > 100, F.concat(F.substring("input", 1, 100), F.lit("..."))).otherwise(
            F.col("input")).alias("preview"),
    )


def csv_view(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``label, confidence, risk_score, flagged_terms, reasoning`` with
    terms joined by ``', '``."""
    return df.select(key, "label", "confidence", "risk_score",
                     F.array_join("flagged_terms", ", ").alias("flagged_terms"), "reasoning")


def review_queue(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows a person must check, highest risk first.  The sort is a
    range shuffle; at scale write it partitioned rather than collect it.
    ``df`` should be a stored results table (or ``session.materialize``d):
    a filter straight on top of ``classify`` gets the whole expression chain
    inlined into its predicate."""
    return (df.filter("requires_human_review")
            .select(key, "label", "risk_score", "confidence", F.array_join("review_reasons", ",").alias("review_reasons"))
            .orderBy(F.desc("risk_score"), F.col(key)))


def batch_request_ids(df: DataFrame, batch_col: str = "batch_id", idx_col: str = "item_idx") -> DataFrame:
    """Item ids ``<batch>_<i>``."""
    return df.withColumn("request_id", F.concat_ws("_", F.col(batch_col).cast("string"), F.col(idx_col).cast("string")))


def chunk_request_ids(df: DataFrame, batch_col: str = "batch_id", idx_col: str = "item_idx",
                      chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """``<batch>_chunk_<k>_<j>`` with ``k = i div size``, ``j = i mod size``.
    Execution chunking itself is Spark's partitioning."""
    k = F.floor(F.col(idx_col) / chunk_size).cast("bigint")
    j = (F.col(idx_col) % chunk_size).cast("bigint")
    return df.withColumns({"chunk_id": k, "chunk_pos": j}).withColumn(
        "request_id", F.concat(F.col(batch_col).cast("string"), F.lit("_chunk_"), k.cast("string"), F.lit("_"),
                               j.cast("string")))


def in_input_order(df: DataFrame, batch_col: str = "batch_id", idx_col: str = "item_idx") -> DataFrame:
    """Numeric order of (batch, item)."""
    return df.orderBy(F.col(batch_col), F.col(idx_col))


def file_items(spark, path: str, fmt: str | None = None, strict: bool = False) -> DataFrame:
    """The items of a text input (S2-S5) with ``reject_reason``: ``malformed``
    (no JSON object), ``empty``, ``blank``, or null for a valid one."""
    from ..operators.validation import single_reject_reason
    from ..sources.io import read_texts

    items = read_texts(spark, path, fmt, strict)
    return items.withColumn("reject_reason", F.when(F.col("malformed").isNotNull(), F.lit("malformed"))
                            .otherwise(single_reject_reason("text")))


def write_logs(results: DataFrame, output: str, key: str, run_id: str | None = None) -> str:
    """Append the results and their audit records to the logs under
    ``output`` (JSON Lines), as one run; returns its id.  ``results`` is read once
    a log: give ``stored_results``, or each log classifies anew.

    Both logs are written to folders of this attempt's own, then one commit
    record, which names the attempt, is published.  ``read_log`` takes the last
    committed attempt of each run, so a run that died between the two logs shows
    nothing, and one that is repeated under its ``run_id`` replaces itself."""
    from ..sources.io import write_json

    attempt = f"a-{uuid.uuid4().hex}"
    run = run_id or attempt
    write_json(with_audit_fields(result_view(results, key), key), f"{output}/result_log/attempt={attempt}")
    write_json(audit_view(results, key), f"{output}/audit_log/attempt={attempt}")
    commit = results.sparkSession.range(1).select(
        F.lit(run).alias("run_id"), F.lit(attempt).alias("attempt"), F.current_timestamp().cast("double").alias("committed_at"))
    write_json(commit, f"{output}/commits", mode="append")
    return run


def read_log(spark, output: str, name: str) -> DataFrame:
    """The rows of ``result_log`` or ``audit_log`` whose run is committed, one
    attempt a run, with its ``run_id``."""
    commits = spark.read.schema("run_id string, attempt string, committed_at double").json(f"{output}/commits")
    last = commits.groupBy("run_id").agg(F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))
    return spark.read.json(f"{output}/{name}").join(last, "attempt").drop("attempt")


def classify_file(spark, path: str, output_path: str | None = None, fmt: str | None = None,
                  scorer=None, rejects_path: str | None = None, log_path: str | None = None, strict: bool = False,
                  **classify_kw) -> DataFrame:
    """I4: read ``.json`` / ``.jsonl`` / ``.txt`` texts (S2-S5), classify the
    valid ones and, when the paths are given, write the results as JSON (S7),
    the rejected items with their reasons, and the result and audit logs (S9,
    S10).  ``strict`` fails on a malformed record instead.  ``scorer`` adds a
    ``probs`` column (e.g. ``operators.scoring.score_with_model``); without one
    every row takes the fallback score.  Returns the result frame
    (``item_idx`` keeps the input order)."""
    from ..sources.io import write_json

    items = file_items(spark, path, fmt, strict)
    valid = items.filter(F.col("reject_reason").isNull()).select("item_idx", "text")
    scored = scorer(valid) if scorer else valid.withColumn("probs", F.lit(None).cast("array<double>"))
    full = classify(scored, **classify_kw)
    if log_path:
        full = stored_results(full, "item_idx")
    res = result_view(full, key="item_idx")
    if output_path:
        write_json(res, output_path)
    if rejects_path:
        write_json(items.filter(F.col("reject_reason").isNotNull()), rejects_path)
    if log_path:
        write_logs(full, log_path, "item_idx")
    return res


def run_batch(df: DataFrame, output_path: str, batch_col: str | None = None, key: str = "doc_id",
              fmt: str = "parquet", rejects_path: str | None = None, **classify_kw) -> dict:
    """Classify ``df`` (rows with empty or blank text are rejected, not
    classified, and written to ``rejects_path`` when that is given), write the
    results, and return the batch stats ``total, processed, failed, elapsed_ms,
    items_per_second``.  The counts come from an ``Observation`` on the write
    of the results - no pass of their own."""
    import time

    from pyspark.sql import Observation

    from ..operators.validation import reject_single

    obs = Observation("batch_stats")
    rejected = reject_single(df)
    checked = rejected.observe(
        obs, F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("reject_reason").isNull()).alias("processed"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("failed"))
    out = classify(checked.filter(F.col("reject_reason").isNull()), **classify_kw)
    cols = [key] + ([batch_col] if batch_col else [])
    t0 = time.perf_counter()
    out.select(*cols, "label", "confidence", "risk_score", "flagged_terms", "requires_human_review",
               "bias_metadata", "reasoning", "rule_amplification").write.mode("overwrite").format(fmt).save(output_path)
    if rejects_path:
        (rejected.filter(F.col("reject_reason").isNotNull()).select(*cols, "text", "reject_reason")
         .write.mode("overwrite").format(fmt).save(rejects_path))
    elapsed = (time.perf_counter() - t0) * 1000.0
    m = obs.get
    stats = {k: int(m.get(k, 0)) for k in ("total", "processed", "failed")}
    stats["elapsed_ms"] = round(elapsed, 2)
    stats["items_per_second"] = round(stats["processed"] / (elapsed / 1000.0), 2) if elapsed > 0 else 0.0
    return stats


def classify_batches(df: DataFrame, batch_col: str = "batch_id", idx_col: str = "item_idx", text_col: str = "text",
                     max_batch: int = 1_000, **classify_kw) -> tuple[DataFrame, DataFrame]:
    """I2 with the batch check of B2: a batch with an empty item or more
    than ``max_batch`` items is rejected as a whole; the items of the other
    batches are classified with ids ``<batch>_<i>``.  Items without a batch are
    rejected as ``no_batch``.  Returns ``(results, batch_rejects)``, one reject
    row per batch.  Only the keys of rejected batches are joined (anti), so
    texts move only if there are too many of those to broadcast."""
    from ..operators.validation import batch_verdicts

    verdicts = batch_verdicts(df, batch_col, idx_col, text_col, max_batch).withColumn(
        "verdict", F.when(F.col(batch_col).isNull(), F.lit("no_batch")).otherwise(F.col("verdict")))
    rejects = verdicts.filter(F.col("verdict").isNotNull())
    ok = df.filter(F.col(batch_col).isNotNull()).join(rejects.select(batch_col), batch_col, "left_anti")
    return batch_request_ids(classify(ok, text_col=text_col, **classify_kw), batch_col, idx_col), rejects
