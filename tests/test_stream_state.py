"""Late rows, the compacted upsert log, limits by kind, the category history."""
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskscope.operators import metrics as M
from riskscope.plans import history as H
from riskscope.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "client string, kind string, ts timestamp"


def _minutes(*rows):
    return [(c, k, None if m is None else T0 + timedelta(minutes=m)) for c, k, m in rows]


def _runs(spark, tmp_dir, goes, job):
    src = os.path.join(tmp_dir, "arriving")
    for rows in goes:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        job(jobs.folder_stream(spark, src, spark.createDataFrame([], SCHEMA).schema))


def test_counts_and_late_rows_add_up(spark, tmp_dir):
    out, late, ck = (os.path.join(tmp_dir, n) for n in ("out", "late", "ck"))
    goes = [_minutes(("a", "single", 0), ("a", "batch", 200), ("a", "single", None)),
            # the watermark is at minute 140: the window to 120 has ended, that to 180 has not
            _minutes(("b", "single", 119), ("b", "single", 120), ("a", "single", 5), ("c", "single", 300)),
            # now at 240, exactly the end of a window
            _minutes(("d", "single", 239), ("d", "single", 240), ("d", "single", None)),
            []]
    _runs(spark, tmp_dir, goes, lambda s: jobs.rate_limit_stream(
        s, "client", "ts", "1 hour", "60 minutes", out, ck, kind_col="kind", late_out=late))
    counts = jobs.latest(spark, out, ["window_start", "client", "kind"]).collect()
    rows = spark.read.parquet(late).collect()
    assert sum(r.n for r in counts) + len(rows) == sum(map(len, goes))
    start = lambda r: int((r.window_start - T0).total_seconds() // 60)
    got = {(r.client, r.kind, start(r)): r.n for r in counts}
    assert got == {("a", "single", 0): 1, ("a", "batch", 180): 1, ("b", "single", 120): 1, ("c", "single", 300): 1, ("d", "single", 240): 1}
    assert sorted((r.client, r.late_reason) for r in rows) == [
        ("a", "late"), ("a", "no_time"), ("b", "late"), ("d", "late"), ("d", "no_time")]
    marks = {r.client: r.watermark for r in rows if r.late_reason == "late"}
    assert marks["b"] == T0 + timedelta(minutes=140) and marks["d"] == T0 + timedelta(minutes=240)


def test_late_rows_refuse_a_clash(spark, tmp_dir):
    src = os.path.join(tmp_dir, "clash")
    df = spark.createDataFrame([(T0, "x")], "ts timestamp, late_reason string")
    df.write.parquet(src)
    with pytest.raises(ValueError, match="late_reason"):
        jobs.part_late(jobs.folder_stream(spark, src, df.schema), "ts", "1 hour", "1 day", src + "-late", src + "-work")


def _state(spark, out):
    return {r.k: r.n for r in jobs.latest(spark, out, ["k"]).collect()}


def _batch(spark, n):
    """Batch n updates three keys of nine; every seventh is empty."""
    keys = [] if n % 7 == 3 else [n % 9, (n * 2) % 9, (n * 5 + 1) % 9]
    return spark.createDataFrame([(k, n * 100 + k) for k in sorted(set(keys))], "k int, n int")


def test_a_log_stays_small_and_right(spark, tmp_dir):
    out, want = os.path.join(tmp_dir, "log"), {}
    for n in range(28):
        jobs.upsert_batch(_batch(spark, n), out, ["k"], n, fan=3)
        want.update({r.k: r.n for r in _batch(spark, n).collect()})
        if n % 4 == 0 or n > 24:
            assert _state(spark, out) == want, n
    folders = [d for d, _sub, files in os.walk(out) if any(f.endswith(".parquet") for f in files)]
    assert len(folders) <= 6 + 6 + 3 + 1  # 28 batches, 9 and 3 folds, one fold of those


def test_a_log_survives_a_death_between_any_two_steps(spark, tmp_dir, monkeypatch):
    from pyspark.sql import DataFrameWriter
    out, want = os.path.join(tmp_dir, "log"), {}
    write = DataFrameWriter.parquet
    for n in range(9):
        steps = 1 + (n % 2 == 1) + (n % 4 == 3) + (n % 8 == 7)  # the batch and its folds, fan 2
        for dies_at in range(steps):
            done = []

            def parquet(self, path, *args, **kw):
                if len(done) == dies_at:
                    raise RuntimeError("lost")
                done.append(path)
                return write(self, path, *args, **kw)

            monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
            with pytest.raises(RuntimeError):
                jobs.upsert_batch(_batch(spark, n), out, ["k"], n, fan=2)
            monkeypatch.undo()
            seen = {**want, **{r.k: r.n for r in _batch(spark, n).collect()}} if dies_at else want
            if n:
                assert _state(spark, out) == seen, (n, dies_at)
        jobs.upsert_batch(_batch(spark, n), out, ["k"], n, fan=2)
        want.update({r.k: r.n for r in _batch(spark, n).collect()})
        assert _state(spark, out) == want, n


def test_limits_by_kind(spark):
    rows = _minutes(*[("a", "single", 0)] * 3, *[("a", "batch", 0)] * 2, *[("a", None, 0)] * 9, *[("a", "other", 0)] * 9, ("b", "batch", 0))
    ev = spark.createDataFrame(rows, SCHEMA)
    flags = lambda limits: {(r.client, r.kind, r.n) for r in M.rate_limit_flags(ev, "client", "ts", "1 minute", limits, "kind").collect()}
    assert flags({"single": 3, "batch": 1}) == {("a", "batch", 2)}
    assert flags({"single": 2, "batch": 2}) == {("a", "single", 3)}
    assert flags({}) == set()
    assert M.rate_limit_flags(ev, "client", "ts", "1 minute", 1).collect()[0].n == 23


def _results(spark, rows):
    return spark.createDataFrame([(label, (cats, bool(cats))) for label, cats in rows],
                                 "label string, bias_metadata struct<detected_categories: array<string>, high_bias_risk: boolean>")


def _history(spark, path):
    return {r.category: (r.total, r.positive) for r in H.history(spark, path).collect()}


def test_history_runs_resets_and_repeats(spark, tmp_dir):
    path = os.path.join(tmp_dir, "history")
    one = _results(spark, [("Non-Radical", ["race"]), ("Radical", ["race", "gender"]), ("Radical", [])])
    two = _results(spark, [("Radical", ["gender"])])
    H.record(one, path, "one")
    H.record(two, path, "two")
    assert _history(spark, path) == {None: (4, 3), "race": (2, 1), "gender": (2, 2)}
    H.record(two, path, "one")  # repeated under its id
    assert _history(spark, path) == {None: (2, 2), "gender": (2, 2)}
    H.reset(spark, path)
    assert _history(spark, path) == {}
    H.record(_results(spark, []), path)
    assert _history(spark, path) == {}
    H.record(one, path, "two")
    assert _history(spark, path) == {None: (3, 2), "race": (2, 1), "gender": (1, 1)}
    assert H.record(one, path) != H.record(one, path)
    assert _history(spark, path)[None] == (9, 6)
