"""Streaming jobs (T1-T6) against their batch forms, plan shape checks and
a brute-force comparison of the flagship query on the small tables."""
import os

import pymodel
import pytest
from pyspark.sql import functions as F

from riskscope.plans import queries as Q
from riskscope.plans.corpus import FIXTURE_PROBS, SEED_PHRASES
from riskscope.session import scratch_path
from riskscope.streaming import jobs

SF_SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

def test_stream_equals_batch(spark):
    a = Q.REGISTRY["stream_classify"][0](spark, SF_SMALL)
    b = Q.REGISTRY["classify_default"][0](spark, SF_SMALL)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_ingest_equals_batch(spark):
    a = Q.REGISTRY["stream_ingest"][0](spark, SF_SMALL).select("doc_id", "reject_reason")
    b = Q.REGISTRY["reject_single"][0](spark, SF_SMALL)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_classify_is_narrow_and_native(spark):
    from riskscope.plans.classify import classify
    from riskscope.plans.corpus import fixture_probs
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("probs", fixture_probs(F.col("doc_id")))
    plan = _physical(classify(docs))
    assert "Exchange" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert "WholeStageCodegen" in plan or "*(" in plan
    assert "Exchange" not in _physical(Q.classified_corpus(spark, SF_SMALL))


def test_scan_prunes_columns(spark):
    df = Q.REGISTRY["label_only"][0](spark, SF_SMALL)
    plan = _physical(df)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_plans_stay_small(spark):
    for name in ("classify_default", "review_queue", "fairness_categories", "counters", "prepare_counts",
                 "parity_by_lang", "eval_report"):
        p = Q.REGISTRY[name][0](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert len(p) < 200_000, name


def test_flagship_matches_python_model(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r.asDict() for r in Q.REGISTRY["classify_default"][0](spark, SF_SMALL).collect()}
    assert set(got) == set(docs)
    for did, text in docs.items():
        t = text + " " + SEED_PHRASES[did % 16]
        probs = None if did % 7 == 0 else FIXTURE_PROBS[did % 5]
        want = pymodel.fuse(pymodel.analyze(pymodel.clean(t)), probs)
        for k, v in want.items():
            assert got[did][k] == v, (did, k)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 200 and "label" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_batch_writes_are_idempotent(spark):
    out = scratch_path(spark, "idem")
    b0 = spark.createDataFrame([("a", 1)], "k string, n long")
    b1 = spark.createDataFrame([("a", 5), ("b", 2)], "k string, n long")
    jobs.write_batch(b0, out, 0)
    jobs.write_batch(b1, out, 1)
    jobs.write_batch(b1, out, 1)  # the same batch re-run after a failure
    got = {r["k"]: r["n"] for r in jobs.latest(spark, out, ["k"]).collect()}
    assert got == {"a": 5, "b": 2} and spark.read.parquet(out).count() == 3


def test_no_python_outside_the_plugin(spark):
    """Only the E6 plug-in scorer may run Python in a batch plan."""
    allowed = {"model_scoring_plugin"}
    skip = {"train_and_score", "evaluate_saved_model", "prepare_manifest_rows", "prepare_rows",
            "labeled_csv_scan", "json_sink", "csv_sink", "append_logs", "read_jsonl", "read_json_array",
            "read_text_lines", "classify_file_rejects", "source_digest"}  # ML fits / file jobs at build time
    for name, (fn, _sql) in Q.REGISTRY.items():
        if name in skip or name.startswith("stream_"):
            continue
        plan = _physical(fn(spark, SF_SMALL))
        has_py = any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "PythonUDF"))
        assert has_py == (name in allowed), name


def test_same_result_for_1_and_8_partitions(spark):
    from riskscope.plans.classify import classify, flat_result
    from riskscope.plans.corpus import fixture_probs, seeded_corpus
    docs = seeded_corpus(spark, SF_SMALL).withColumn("probs", fixture_probs(F.col("doc_id")))
    one = flat_result(classify(docs.repartition(1))).collect()
    eight = flat_result(classify(docs.repartition(8))).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, eight))


def _arriving(spark, tmp_dir, frames, job):
    """Feed a job from a folder that gets one frame's files before each run."""
    src = os.path.join(tmp_dir, "arriving")
    for df in frames:
        df.repartition(2).write.mode("append").parquet(src)
        job(jobs.folder_stream(spark, src, df.schema, max_files_per_trigger=1))


def test_streams_go_on_after_a_restart(spark, tmp_dir):
    """Two runs with files added between equal the batch."""
    from riskscope.operators import validation as V
    from riskscope.plans.classify import classify, flat_result
    docs = Q._corpus_frame(spark, SF_SMALL)
    halves = [docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")]
    out, ck = os.path.join(tmp_dir, "t1"), os.path.join(tmp_dir, "t1-ck")
    _arriving(spark, os.path.join(tmp_dir, "a"), halves, lambda s: jobs.classify_stream(s, out, ck))
    got = flat_result(spark.read.parquet(out))
    want = flat_result(classify(docs))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    valid, rejects, ck6 = (os.path.join(tmp_dir, n) for n in ("valid", "rejects", "t6-ck"))
    faulty = Q.faulty_documents(spark, SF_SMALL)
    _arriving(spark, os.path.join(tmp_dir, "b"), [faulty.where("doc_id < 90"), faulty.where("doc_id >= 90")],
              lambda s: jobs.ingest_stream(s, "text", valid, rejects, ck6))
    n = {r["r"]: r["n"] for r in V.reject_single(faulty).groupBy(F.col("reject_reason").alias("r")).agg(F.count("*").alias("n")).collect()}
    assert spark.read.parquet(valid).count() == n[None]
    assert spark.read.parquet(rejects).count() == n["empty"] + n["blank"]
    assert spark.read.parquet(valid).where("text <> trim(text)").count() == 0
    assert spark.read.parquet(valid).select("batch_id").distinct().count() >= 4


def test_registered_streams_equal_their_batch_forms(spark):
    for name, batch in (("stream_rate_limit", "rate_limit_flags"), ("stream_categories", "fairness_categories")):
        a, b = (Q.REGISTRY[n][0](spark, SF_SMALL) for n in (name, batch))
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect())), name


def test_no_machine_local_folder_on_a_cluster():
    from riskscope import session
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session._local_fallback("yarn")
    with pytest.raises(ValueError):
        session._local_fallback("local-cluster[2,1,1024]")
    assert os.path.isdir(session._local_fallback("local[2]"))


def test_every_micro_batch_has_a_file_for_every_core(spark):
    df, seen = spark.range(500).withColumn("v", F.col("id") * 2), []

    def job(stream):
        jobs._run(stream.writeStream.foreachBatch(lambda b, i: seen.append(
            (i, b.count(), b.select(F.input_file_name()).distinct().count()))), checkpoint)

    checkpoint = scratch_path(spark, "spread-ckpt")
    Q.staged_runs(spark, df, "spread", job)
    cores = spark.sparkContext.defaultParallelism
    assert [(i, files) for i, _, files in seen] == [(i, cores) for i in range(4)]
    assert sum(rows for _, rows, _ in seen) == 500
    seen.clear()
    checkpoint = scratch_path(spark, "whole-ckpt")
    Q.staged_runs(spark, df, "whole", job, go=F.col("id") % 2, batches=1)
    assert seen == [(0, 250, cores), (1, 250, cores)]
