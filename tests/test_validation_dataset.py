"""Validation (B1-B5), normalise / dedupe (B6-B7) and splits."""
import pytest
from pyspark.sql import functions as F

from riskscope.operators import dataset as D
from riskscope.operators import validation as V


def test_reject_reasons(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, " \t "), (3, "ok")], "k int, text string")
    got = {r["k"]: r["reject_reason"] for r in V.reject_single(df).collect()}
    assert got == {0: "empty", 1: "empty", 2: "blank", 3: None}


def test_batch_verdicts(spark):
    rows = [(1, i, "x") for i in range(5)] + [(2, 0, "a"), (2, 1, ""), (2, 2, "   "), (3, 0, "b")]
    df = spark.createDataFrame(rows, "batch_id int, item_idx int, text string")
    got = {r["batch_id"]: (r["batch_size"], r["first_empty_idx"], r["verdict"])
           for r in V.batch_verdicts(df, max_batch=4).collect()}
    assert got == {1: (5, None, "batch_too_large"), 2: (3, 1, "empty_item"), 3: (1, None, None)}


def test_strict_profile(spark):
    rows = [(1, "x" * 10_001), (1, "ok"), (2, " ")] + [(3, "t")] * 3
    df = spark.createDataFrame(rows, "batch_id int, text string")
    got = sorted((r["batch_id"], r["reject_reason"] or "") for r in V.reject_strict(df, max_batch=2).collect())
    assert got == [(1, ""), (1, "too_long"), (2, "blank"), (3, "batch_too_large")] + [(3, "batch_too_large")] * 2


def test_frame_checks(spark):
    with pytest.raises(ValueError, match="missing"):
        V.frame_checks(spark.createDataFrame([(0, "a")], "k int, text string"), "k")
    df = spark.createDataFrame([(0, "a", 4.0), (1, None, 1.0), (2, "b", 1.7), (3, "c", None), (4, "d", -1.0)],
                               "k int, text string, label double")
    r = V.frame_checks(df, "k").first()
    assert (r["null_text"], r["null_label"], r["non_integer_labels"], r["out_of_range"]) == (1, 1, 1, 2)
    assert r["first_null_text_keys"] == "1" and not r["valid"]


def test_normalize(spark):
    df = spark.createDataFrame([(0, "  hi  "), (1, "  "), (2, "x")], "k int, text string")
    rows, stats = D.normalize(df, "text", drop_empty_text=True)
    assert sorted(r["text"] for r in rows.collect()) == ["hi", "x"]
    assert stats.first()["dropped_empty"] == 1
    _rows, stats2 = D.normalize(df, "text", drop_empty_text=False)
    assert stats2.first()["blank_rows"] == 1 and stats2.first()["dropped_empty"] == 0
    rows3, stats3 = D.normalize(spark.createDataFrame([(0, "abcdef")], "k int, text string"), "text", True, 3)
    assert rows3.first()["text"] == "abc" and stats3.first()["truncated_rows"] == 1


def test_dedupe_keeps_smallest_key(spark):
    df = spark.createDataFrame([(5, "a", "x"), (2, "a", "y"), (3, "b", "z")], "k int, text string, other string")
    got = sorted((r["k"], r["other"]) for r in D.dedupe_text(df, "k").collect())
    assert got == [(2, "y"), (3, "z")]


def _frame(spark, n=100, parts=4):
    return spark.createDataFrame([(i, f"t{i}", i % 4) for i in range(n)], "k long, text string, label int").repartition(parts)


def test_split_sizes_and_strata(spark):
    sp = D.stratified_split(_frame(spark), "k", "label").collect()
    sizes = {s: sum(1 for r in sp if r["split"] == s) for s in ("train", "val", "test")}
    assert abs(sizes["train"] - 70) <= 1 and abs(sizes["val"] - 15) <= 1 and abs(sizes["test"] - 15) <= 1
    for s in ("train", "val", "test"):
        assert {r["label"] for r in sp if r["split"] == s} == {0, 1, 2, 3}


def test_split_independent_of_partitioning(spark):
    a = {r["k"]: r["split"] for r in D.stratified_split(_frame(spark, 500, 1), "k", "label").collect()}
    b = {r["k"]: r["split"] for r in D.stratified_split(_frame(spark, 500, 8), "k", "label").collect()}
    assert a == b


def test_split_rejects_tiny_class_and_bad_fractions(spark):
    df = spark.createDataFrame([(i, "t", 0) for i in range(20)] + [(99, "u", 1)], "k long, text string, label int")
    sp = D.stratified_split(df, "k", "label").collect()
    assert [r["split_error"] for r in sp if r["label"] == 1] == ["class has fewer than 3 rows"]
    with pytest.raises(ValueError, match="sum to 1"):
        D.stratified_split(df, "k", "label", (0.5, 0.2, 0.2))


def test_histogram_and_manifest_counts(spark):
    sp = D.stratified_split(_frame(spark), "k", "label")
    m = {r["split"]: (r["rows"], dict(r["label_counts"])) for r in D.manifest_counts(sp).collect()}
    assert m["before_split"] == (100, {"0": 25, "1": 25, "2": 25, "3": 25})
    assert sum(m[s][0] for s in ("train", "val", "test")) == 100
    assert {r["label"]: r["n"] for r in D.label_histogram(_frame(spark)).collect()} == {0: 25, 1: 25, 2: 25, 3: 25}


def test_split_flags_out_of_range_labels(spark):
    df = spark.createDataFrame([(i, "t", i % 2) for i in range(40)] + [(100, "u", 7), (101, "v", None)],
                               "k long, text string, label int")
    sp = {r["k"]: (r["split"], r["split_error"]) for r in D.stratified_split(df, "k", "label").collect()}
    assert sp[100] == (None, "label outside [0, 4)") and sp[101] == (None, "label outside [0, 4)")
    assert sum(1 for k, v in sp.items() if v[0] is not None) == 40


def test_split_quotas_exact_for_huge_counts(spark):
    ns = [4_000_000_007, 3_000_000_011, 2_000_000_003, 999_999_937]
    counts = spark.createDataFrame(list(enumerate(ns)), "label int, n long")
    q = {r["label"]: (r["n_test"], r["n_val"]) for r in D.split_quotas(counts, (0.7, 0.15, 0.15)).collect()}
    total = sum(ns)
    t = int(total * 0.15 + 0.5)
    base = [n * t // total for n in ns]
    rem = [n * t % total for n in ns]
    order = sorted(range(4), key=lambda i: (-rem[i], i))
    want = {i: base[i] + (1 if order.index(i) < t - sum(base) else 0) for i in range(4)}
    assert {i: q[i][0] for i in q} == want and sum(v[0] for v in q.values()) == t


def _quotas_py(ns, frac):
    total = sum(ns)
    t = int(total * frac + 0.5)
    base = [n * t // total for n in ns]
    rem = [n * t % total for n in ns]
    order = sorted(range(len(ns)), key=lambda i: (-rem[i], i))
    extra = t - sum(base)
    return [base[i] + (1 if order.index(i) < extra else 0) for i in range(len(ns))]


def test_split_quotas_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.integers(min_value=3, max_value=80), min_size=1, max_size=4))
    def check(ns):
        rows = [(i * 1000 + j, f"t{i}-{j}", i) for i, n in enumerate(ns) for j in range(n)]
        df = spark.createDataFrame(rows, "k long, text string, label int")
        sp = D.stratified_split(df, "k", "label", (0.7, 0.15, 0.15)).collect()
        assert len(sp) == sum(ns) and len({r["k"] for r in sp}) == sum(ns)
        test_q, val_q = _quotas_py(ns, 0.15), _quotas_py(ns, 0.15)
        for i, n in enumerate(ns):
            got = {s: sum(1 for r in sp if r["label"] == i and r["split"] == s) for s in ("train", "val", "test")}
            assert got["test"] == test_q[i]
            assert got["val"] == min(val_q[i], n - test_q[i])
            assert got["train"] == n - got["test"] - got["val"]

    check()
