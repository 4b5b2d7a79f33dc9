"""Result and audit logs: one commit a run."""
import os

import pytest
from pyspark.sql import functions as F

from riskscope.plans import classify as C
from riskscope.sources import io


def _results(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("probs", F.lit(None).cast("array<double>"))
    return C.classify(df)


def _counts(spark, path):
    return [C.read_log(spark, path, n).count() for n in ("result_log", "audit_log")]


def test_a_repeated_run_replaces_itself(spark, tmp_dir):
    path = os.path.join(tmp_dir, "logs")
    C.write_logs(_results(spark, ["a", "b"]), path, "doc_id", "one")
    C.write_logs(_results(spark, ["c"]), path, "doc_id", "two")
    assert _counts(spark, path) == [3, 3]
    C.write_logs(_results(spark, ["a", "b", "x"]), path, "doc_id", "one")
    assert _counts(spark, path) == [4, 4]
    assert C.write_logs(_results(spark, ["d"]), path, "doc_id") not in ("one", "two")
    assert _counts(spark, path) == [5, 5]
    assert {r.run_id for r in C.read_log(spark, path, "audit_log").collect()} >= {"one", "two"}


def test_a_run_that_dies_between_the_logs_shows_nothing(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "logs")
    C.write_logs(_results(spark, ["a"]), path, "doc_id", "one")
    write = io.write_json

    def dies(df, where, mode="overwrite"):
        if "audit_log" in where:
            raise RuntimeError("lost")
        write(df, where, mode)

    monkeypatch.setattr(io, "write_json", dies)
    with pytest.raises(RuntimeError):
        C.write_logs(_results(spark, ["b", "c"]), path, "doc_id", "two")
    monkeypatch.undo()
    assert _counts(spark, path) == [1, 1]
    C.write_logs(_results(spark, ["b", "c"]), path, "doc_id", "two")
    assert _counts(spark, path) == [3, 3]


def _counted(spark, df):
    """``df``, and how many of its rows were worked out so far."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_two_runs_and_a_repeat_classify_once(spark, monkeypatch):
    from riskscope.plans import queries as Q
    df, seen = _counted(spark, _results(spark, ["kill the enemy", "b", "", None]))
    monkeypatch.setattr(Q, "classified_corpus", lambda *a: df)
    got = Q.REGISTRY["append_logs"][0](spark, "").collect()
    assert sorted((r.doc_id, r.n_results, r.n_audits) for r in got) == [(i, 2, 2) for i in range(4)]
    assert seen.value == 4


def test_a_logged_file_is_scored_once(spark, tmp_dir):
    path, out, logs = (os.path.join(tmp_dir, n) for n in ("in.txt", "out", "logs"))
    with open(path, "w") as f:
        f.write("one\ntwo\nthree\n")
    seen = []

    def scorer(valid):
        df, n = _counted(spark, valid)
        seen.append(n)
        return df.withColumn("probs", F.lit(None).cast("array<double>"))

    res = C.classify_file(spark, path, out, scorer=scorer, log_path=logs)
    assert res.count() == 3 and _counts(spark, logs) == [3, 3] and spark.read.json(out).count() == 3
    assert [n.value for n in seen] == [3]
