"""Scans and sinks (S1-S14) and the preparation job (H3)."""
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from riskscope.plans.prepare import PrepareOptions, prepare
from riskscope.sources import io


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_bom_multiline_and_null_tokens(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "a.csv"), '﻿text,label\n"hi, ""there""",1\n"two\nlines",0\nNA,2\n'.encode())
    df = io.load_labeled_csv(spark, p)
    assert df.columns == ["text", "label"]
    assert [tuple(r) for r in df.collect()] == [('hi, "there"', "1"), ("two\nlines", "0"), (None, "2")]


def test_invalid_utf8_fails(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "b.csv"), b"text,label\n\"ok \xff\",1\n")
    with pytest.raises(ValueError, match="UTF-8"):
        io.load_labeled_csv(spark, p)


def test_read_texts_formats(spark, tmp_dir):
    j = _write(os.path.join(tmp_dir, "a.json"), b'[{"text": "one"}, {"content": "two"}, {"other": 1}]')
    jl = _write(os.path.join(tmp_dir, "a.jsonl"), b'{"text": "one"}\n{"content": "two"}\n')
    t = _write(os.path.join(tmp_dir, "a.txt"), b"  one  \n\n   \ntwo\n")
    assert [r["text"] for r in io.read_texts(spark, j).orderBy("item_idx").collect()] == ["one", "two", ""]
    assert [r["text"] for r in io.read_texts(spark, jl).orderBy("item_idx").collect()] == ["one", "two"]
    assert [r["text"] for r in io.read_texts(spark, t).orderBy("item_idx").collect()] == ["one", "two"]
    with pytest.raises(ValueError, match="known formats"):
        io.read_texts(spark, os.path.join(tmp_dir, "a.csv"))


def test_digest_matches_hashlib(spark, tmp_dir):
    data = b"text,label\nhello,1\n" * 100
    p = _write(os.path.join(tmp_dir, "d.csv"), data)
    r = io.dataset_digest(io.file_digests(spark, p)).first()
    assert r["sha256"] == hashlib.sha256(data).hexdigest() and r["size_bytes"] == len(data)


def test_manifest_json_sorted():
    s = io.manifest_json({"b": 1, "a": {"d": 2, "c": 3}})
    assert s == json.dumps({"a": {"c": 3, "d": 2}, "b": 1}, indent=2, sort_keys=True) + "\n"


def test_prepare_end_to_end(spark, tmp_dir):
    rows = "".join(f'"text {i}",{i % 4}\n' for i in range(100)) + '"   ",1\n"text 1",1\n'
    p = _write(os.path.join(tmp_dir, "in.csv"), ("text,label\n" + rows).encode())
    out = os.path.join(tmp_dir, "out")
    m = prepare(spark, p, out, PrepareOptions(remove_duplicates=True))
    r = m["rows"]
    assert (r["loaded"], r["dropped_empty_text"], r["after_normalize"], r["duplicates_removed"]) == (102, 1, 101, 1)
    assert r["train"] + r["val"] + r["test"] == 100
    assert m["label_counts"]["before_split"] == {"0": 25, "1": 25, "2": 25, "3": 25}
    assert all(set(m["label_counts"][s]) == {"0", "1", "2", "3"} for s in ("train", "val", "test"))
    assert m["source"]["sha256"] == hashlib.sha256(open(p, "rb").read()).hexdigest()
    written = json.loads("".join(spark.read.text(os.path.join(out, "split_manifest")).toPandas()["value"]))
    assert written["rows"] == r


def test_prepare_failures(spark, tmp_dir):
    bad = _write(os.path.join(tmp_dir, "bad.csv"), b"text,label\nx,4\n")
    with pytest.raises(ValueError, match="no class from 0 to 3"):
        prepare(spark, bad, os.path.join(tmp_dir, "o1"))
    blank = _write(os.path.join(tmp_dir, "blank.csv"), b"text,label\n\"   \",1\nx,1\n")
    with pytest.raises(ValueError, match="texts are blank"):
        prepare(spark, blank, os.path.join(tmp_dir, "o2"), PrepareOptions(drop_empty_text=False))
    nolabel = _write(os.path.join(tmp_dir, "nl.csv"), b"text\nx\n")
    with pytest.raises(ValueError, match="no column label"):
        prepare(spark, nolabel, os.path.join(tmp_dir, "o3"))


def test_classify_file_and_batch_stats(spark, tmp_dir):
    from riskscope.plans.classify import classify_file, run_batch
    p = _write(os.path.join(tmp_dir, "in.jsonl"),
               b'{"text": "stop the attack now"}\n{"content": "a calm day"}\n{"other": 1}\n')
    out = os.path.join(tmp_dir, "res")
    res = classify_file(spark, p, out)
    rows = res.orderBy("item_idx").collect()
    assert len(rows) == 2 and rows[0]["flagged_terms"] == ["attack"]
    assert "ML model unavailable" in rows[1]["reasoning"]
    assert spark.read.json(out).count() == 2
    df = spark.createDataFrame([(1, "kill"), (2, ""), (3, "fine"), (4, "  ")], "doc_id long, text string")
    df = df.withColumn("probs", F.lit(None).cast("array<double>"))
    st = run_batch(df, os.path.join(tmp_dir, "batch"))
    assert (st["total"], st["processed"], st["failed"]) == (4, 2, 2) and st["elapsed_ms"] > 0


def test_append_only_logs_and_result_projection(spark, tmp_dir):
    from riskscope.plans.classify import audit_view, classify, result_view, with_audit_fields
    df = spark.createDataFrame([(1, "stop the attack", None), (2, "a calm day", [0.9, 0.05, 0.03, 0.02])],
                               "doc_id long, text string, probs array<double>")
    res = with_audit_fields(result_view(classify(df)))
    assert res.columns == ["doc_id", "input", "label", "confidence", "risk_score", "flagged_terms",
                           "requires_human_review", "bias_metadata", "reasoning", "rule_amplification",
                           "request_id", "processed_at", "audit_id"]
    rows = res.collect()
    assert len({r["audit_id"] for r in rows}) == 2 and all(r["processed_at"] is not None for r in rows)
    log = os.path.join(tmp_dir, "results_log")
    io.write_json(res, log, mode="append")
    io.write_json(res, log, mode="append")
    assert spark.read.json(log).count() == 4
    audit = os.path.join(tmp_dir, "audit_log")
    io.write_json(audit_view(classify(df)), audit, mode="append")
    assert set(spark.read.json(audit).columns) >= {"request_id", "label", "risk_score", "confidence",
                                                   "requires_human_review", "bias_risk", "preview"}


def test_malformed_json_is_rejected_not_lost(spark, tmp_dir):
    from riskscope.plans.classify import classify_file
    p = _write(os.path.join(tmp_dir, "m.jsonl"), b'{"text": "fine"}\n{"text": broken\n{"other": 1}\n{"text": "  "}\n')
    rej = os.path.join(tmp_dir, "rej")
    assert classify_file(spark, p, rejects_path=rej).count() == 1
    got = {r["reject_reason"]: r["malformed"] if "malformed" in r else None for r in spark.read.json(rej).collect()}
    assert set(got) == {"malformed", "empty", "blank"} and "broken" in got["malformed"]
    with pytest.raises(Exception):
        io.read_texts(spark, p, strict=True).collect()


def test_large_file_digest_ignores_the_cut(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "big.csv"), b"".join(b"line %d\n" % (k % 700) for k in range(20000)))
    one = io.file_digests(spark, p, whole_file_bytes=100).first()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        many = io.file_digests(spark, p, whole_file_bytes=100).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert one["kind"] == "lines" and one["sha256"] == many["sha256"] and one["size_bytes"] == os.path.getsize(p)


def test_prepare_keeps_good_output_and_ignores_file_layout(spark, tmp_dir):
    rows = [(f"text {i % 90}  ", i % 4) for i in range(120)]
    splits = []
    for k, parts in enumerate((1, 5)):
        src = os.path.join(tmp_dir, f"src{k}")
        (spark.createDataFrame(rows, "text string, label int").repartition(parts).write.option("header", True)
         .option("ignoreTrailingWhiteSpace", False).csv(src))
        m = prepare(spark, src, os.path.join(tmp_dir, f"out{k}"))
        splits.append(sorted((r["text"], r["label"], r["split"]) for r in io.read_splits(spark, m["splits"]).collect()))
    assert splits[0] == splits[1] and len(splits[0]) == 120
    bad = _write(os.path.join(tmp_dir, "bad.csv"), b"text,label\n" + b"x,0\n" * 9 + b"y,1\n")
    with pytest.raises(ValueError, match="class 1 has 1 rows"):
        prepare(spark, bad, os.path.join(tmp_dir, "out0"))
    assert io.read_splits(spark, json.loads("".join(r["value"] for r in spark.read.text(
        os.path.join(tmp_dir, "out0", "split_manifest")).collect()))["splits"]).count() == 120
    text = _write(os.path.join(tmp_dir, "abc.csv"), b"text,label\nx,abc\ny,1\n")
    with pytest.raises(ValueError, match="abc"):
        prepare(spark, text, os.path.join(tmp_dir, "out9"))


def test_json_array_query_reads_arrays_of_several_documents(spark, monkeypatch):
    import json

    from riskscope.plans import queries
    from riskscope.sources import io

    seen, read = [], io.read_texts
    monkeypatch.setattr(io, "read_texts", lambda s, path, fmt=None, strict=False: seen.append((path, fmt)) or read(s, path, fmt, strict))
    sf = "/root/testdata/sf0.001"
    rows = queries.q_read_json_array(spark, sf).collect()
    (path, fmt), = seen
    arrays = [json.loads(r.value) for r in spark.read.option("wholetext", True).text(path).collect()]
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert fmt == ".json" and min(map(len, arrays)) > 1
    assert sum(map(len, arrays)) == sum(r.n for r in rows) == n
