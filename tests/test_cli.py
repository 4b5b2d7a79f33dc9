"""Command-line entry: classify a file, classify a table, report, prepare."""
import json
import os

from riskscope.__main__ import main


def test_cli_round_trip(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in.jsonl")
    with open(src, "w") as f:
        f.write('{"text": "stop the attack now"}\n{"content": "fight for freedom"}\n')
    assert main(["classify", src, os.path.join(tmp_dir, "out_json")], spark) == 0
    assert spark.read.json(os.path.join(tmp_dir, "out_json")).count() == 2

    table = os.path.join(tmp_dir, "docs.parquet")
    spark.createDataFrame([(1, "the enemy is corrupt", "en"), (2, "our people", "fr"), (3, "calm", "en")],
                          "doc_id long, text string, lang string").write.parquet(table)
    res = os.path.join(tmp_dir, "results")
    assert main(["classify", table, res], spark) == 0
    r = spark.read.parquet(res)
    assert r.count() == 3 and "requires_human_review" in r.columns

    r2 = os.path.join(tmp_dir, "results_lang")
    r.join(spark.read.parquet(table).select("doc_id", "lang"), "doc_id").write.parquet(r2)
    assert main(["report", r2, os.path.join(tmp_dir, "report")], spark) == 0
    summary = spark.read.json(os.path.join(tmp_dir, "report", "fairness_summary")).first()
    assert summary["total_processed"] == 3

    csv = os.path.join(tmp_dir, "lab.csv")
    with open(csv, "w") as f:
        f.write("text,label\n" + "".join(f"t{i},{i % 4}\n" for i in range(40)))
    assert main(["prepare", csv, os.path.join(tmp_dir, "prep"), "--remove-duplicates"], spark) == 0
    m = json.loads("".join(spark.read.text(os.path.join(tmp_dir, "prep", "split_manifest")).toPandas()["value"]))
    assert m["rows"]["train"] + m["rows"]["val"] + m["rows"]["test"] == 40
