"""Command-line entry for the batch jobs (run with ``python -m riskscope`` or
``spark-submit``):

    classify INPUT OUTPUT [--format json|jsonl|txt|parquet] [--text-col text] [--key doc_id] [--max-chars N]
                          [--rules FILE.yaml] [--cut-points 25,50,75] [--view full|label|csv|raw]
                          [--rejects DIR] [--logs DIR] [--strict]
    prepare  INPUT_CSV OUTPUT_DIR [--train .7 --val .15 --test .15 --seed 42 --num-labels 4
                                   --no-drop-empty-text --max-text-chars N --remove-duplicates --no-manifest --whole-files]
    report   RESULTS OUTPUT [--group-col lang --reference-group en]

``classify`` reads texts (S2-S5) or a parquet table, classifies them (I1;
rows without a ``probs`` column take the fallback score) and writes the
results as JSON, CSV or parquet; rejected rows go to OUTPUT_rejects or
``--rejects``.  ``prepare`` is H3.  ``report`` reads a stored
results table and writes the fairness summary, concerns, per-group rates
and counters, each as one small JSON output.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riskscope")
    sub = p.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("classify")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--format", choices=["json", "jsonl", "txt", "parquet"])
    c.add_argument("--text-col", default="text")
    c.add_argument("--key", default="doc_id")
    c.add_argument("--max-chars", type=int, default=None)
    c.add_argument("--rules")
    c.add_argument("--cut-points")
    c.add_argument("--view", choices=["full", "label", "csv", "raw"], default="full")
    c.add_argument("--rejects")
    c.add_argument("--logs")
    c.add_argument("--strict", action="store_true")
    r = sub.add_parser("prepare")
    r.add_argument("input_csv")
    r.add_argument("output_dir")
    r.add_argument("--train", type=float, default=0.7)
    r.add_argument("--val", type=float, default=0.15)
    r.add_argument("--test", type=float, default=0.15)
    r.add_argument("--seed", type=int, default=42)
    r.add_argument("--num-labels", type=int, default=4)
    r.add_argument("--no-drop-empty-text", action="store_true")
    r.add_argument("--max-text-chars", type=int, default=None)
    r.add_argument("--remove-duplicates", action="store_true")
    r.add_argument("--no-manifest", action="store_true")
    r.add_argument("--whole-files", action="store_true", help="one task a file: allows quotes inside unquoted fields")
    f = sub.add_parser("report")
    f.add_argument("results")
    f.add_argument("output")
    f.add_argument("--group-col", default="lang")
    f.add_argument("--reference-group", default="en")
    return p


def _classify(spark, a) -> None:
    from dataclasses import replace

    from .operators.validation import reject_single
    from .params import DEFAULT_FUSION, DEFAULT_LEXICON, Lexicon
    from .plans import classify as C
    from .sources.io import write_json

    table = a.format == "parquet" or (a.format is None and a.input.rstrip("/").endswith(".parquet"))
    if table:
        key = a.key
        df = spark.read.parquet(a.input)
        df = df.withColumnRenamed(a.text_col, "text") if a.text_col != "text" else df
        items = reject_single(df)
    else:
        key = "item_idx"
        items = C.file_items(spark, a.input, f".{a.format}" if a.format else None, a.strict)
    params = DEFAULT_FUSION
    if a.cut_points:
        params = replace(params, cutpoints=tuple(int(x) for x in a.cut_points.split(",")))
    lexicon = Lexicon.from_yaml(a.rules) if a.rules else DEFAULT_LEXICON
    valid = items.filter(F.col("reject_reason").isNull()).drop("reject_reason", "malformed")
    full = C.classify(valid, lexicon=lexicon, params=params, max_chars=a.max_chars)
    logged = C.stored_results(full, key) if a.logs else None
    full = full if a.view == "raw" or not a.logs else logged
    view = {"full": lambda: C.result_view(full, key), "label": lambda: full.select(key, "label"),
            "csv": lambda: C.csv_view(full, key), "raw": lambda: C.raw_view(full, key)}[a.view]()
    if a.view == "csv":
        view.write.mode("overwrite").option("header", True).option("escape", '"').csv(a.output)
    elif table:
        view.write.mode("overwrite").parquet(a.output)
    else:
        write_json(view, a.output)
    rejects = items.filter(F.col("reject_reason").isNotNull())
    write_json(rejects.select(key, "text", "reject_reason"), a.rejects or f"{a.output.rstrip('/')}_rejects")
    if a.logs:
        C.write_logs(logged, a.logs, key)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    from .session import build_session
    spark = spark or build_session()
    if a.cmd == "classify":
        _classify(spark, a)
    elif a.cmd == "prepare":
        from .plans.prepare import PrepareOptions, prepare
        opts = PrepareOptions(train=a.train, val=a.val, test=a.test, seed=a.seed, num_labels=a.num_labels,
                              drop_empty_text=not a.no_drop_empty_text, max_text_chars=a.max_text_chars,
                              remove_duplicates=a.remove_duplicates)
        m = prepare(spark, a.input_csv, a.output_dir, opts, manifest=not a.no_manifest, splittable=not a.whole_files)
        r = m["rows"]
        print(json.dumps({"output": a.output_dir, **{s: r[s] for s in ("train", "val", "test")}}))
    else:
        from .operators import fairness, metrics
        res = spark.read.parquet(a.results)
        outputs = {"fairness_summary": fairness.summary(res), "fairness_concerns": fairness.concerns(res),
                   "group_rates": fairness.group_rates(res, a.group_col, a.reference_group),
                   "counters": metrics.counters(res)}
        for name, df in outputs.items():
            df.coalesce(1).write.mode("overwrite").json(f"{a.output.rstrip('/')}/{name}")
        print(json.dumps({k: f"{a.output.rstrip('/')}/{k}" for k in outputs}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
