"""H3: the whole dataset preparation as one Spark job graph.

validate -> normalise -> (dedupe) -> decide -> stratified split -> one
partitioned write -> manifest.  Everything that can refuse the input runs
before anything is published: the splits go to a folder of their own below the
output, and the manifest, written last, names it.

A row is known by its content (the digest of all its columns), so the split
does not depend on how the input's files are cut into tasks.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset as D
from ..operators import validation as V
from ..session import scratch_path
from ..sources import io


@dataclass(frozen=True)
class PrepareOptions:
    train: float = 0.7
    val: float = 0.15
    test: float = 0.15
    seed: int = 42
    num_labels: int = 4
    drop_empty_text: bool = True
    max_text_chars: int | None = None
    remove_duplicates: bool = False


SPLIT_80_10_10 = PrepareOptions(train=0.8, val=0.1, test=0.1)


def _one(df: DataFrame) -> dict:
    """First row of a one-row aggregate frame as a dict."""
    return df.first().asDict()


def content_key(df: DataFrame):
    """The digest of all columns of a row, each with its length before it."""
    parts = [F.coalesce(F.concat(F.length(F.col(c)).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
             for c in df.columns]
    return F.sha2(F.concat(*parts), 256)


def prepare(spark: SparkSession, input_csv: str, output_dir: str, opts: PrepareOptions = PrepareOptions(),
            manifest: bool = True, tool: str = "prepare_dataset", splittable: bool = True) -> dict:
    """Run the preparation; returns the manifest dict (also written as
    ``<output_dir>/split_manifest`` unless ``manifest`` is False; only then is
    the source digested).  Raises ``ValueError`` on invalid input, before an
    earlier output is touched.  ``splittable=False`` reads a CSV with quotes
    inside unquoted fields, one task a file."""
    total = opts.train + opts.val + opts.test
    if abs(total - 1.0) > 1e-6:
        raise ValueError(f"the fractions add up to {total}, not 1")
    raw = io.load_labeled_csv(spark, input_csv, splittable=splittable)
    io.require_columns(raw)

    checks = _one(V.frame_summary(raw, opts.num_labels))   # one pass; details only on failure
    for name, what in (("null_text", "rows without text"), ("null_label", "rows without a label")):
        if checks[name]:
            raise ValueError(f"{input_csv}: {checks[name]} {what}")
    if checks["non_integer_labels"] or checks["out_of_range"]:
        bad = V.bad_label_values(raw, opts.num_labels).orderBy(F.desc("n"), "value").limit(5).collect()
        some = ", ".join(f"{r['value']} ({r['n']} rows)" for r in bad)
        raise ValueError(f"{checks['non_integer_labels'] + checks['out_of_range']} labels are no class from 0 to "
                         f"{opts.num_labels - 1}, most often {some}")

    typed = raw.withColumn("__row", content_key(raw)).withColumn("label", F.col("label").cast("double").cast("int"))
    # The normalisation counts are observed while the prepared rows are
    # written below: no separate pass over the input for them.
    obs = Observation("normalize")
    rows, _stats = D.normalize(typed, "text", drop_empty_text=opts.drop_empty_text,
                               max_text_chars=opts.max_text_chars, observation=obs)
    rows = rows.withColumn("__id", F.monotonically_increasing_id())
    stored = scratch_path(spark, "prepared")
    rows.write.parquet(stored)
    data = spark.read.parquet(stored)
    seen = obs.get
    blank = int(seen.get("blank_rows", 0))
    if blank and not opts.drop_empty_text:
        raise ValueError(f"{blank} texts are blank, and dropping them is switched off")
    after_normalize = int(seen.get("rows_in", 0)) - (blank if opts.drop_empty_text else 0)
    if after_normalize == 0:
        raise ValueError("no row is left to split")
    if opts.remove_duplicates:
        # Equal rows share their content key: the running number tells them apart.
        keyed = data.withColumn("__one", F.concat_ws(":", "__row", F.format_string("%020d", "__id")))
        data = D.dedupe_text(keyed, "__one", "text").drop("__one")
    small = data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n < 3").orderBy("label").first()
    if small:
        raise ValueError(f"class {small['label']} has {small['n']} rows; a split takes 3 at least")

    split = D.stratified_split(data, "__row", "label", (opts.train, opts.val, opts.test), opts.seed,
                               num_labels=opts.num_labels, tie="__id")
    folder = f"{output_dir}/splits/{uuid.uuid4().hex}"
    # The rows of each class and split are counted as they are written.
    written = Observation("splits")
    cells = [(s, c) for s in ("train", "val", "test") for c in range(opts.num_labels)]
    io.write_splits(split.select(*raw.columns, "split").observe(written, *(
        F.count_if((F.col("split") == s) & (F.col("label") == c)).alias(f"{s}_{c}") for s, c in cells)), folder)
    counted = written.get
    counts = {(s, c): int(counted.get(f"{s}_{c}", 0)) for s, c in cells if counted.get(f"{s}_{c}", 0)}

    def hist(s=None):
        out: dict[str, int] = {}
        for (sp, lab), n in sorted(counts.items(), key=lambda kv: kv[0][1]):
            if s is None or sp == s:
                out[str(lab)] = out.get(str(lab), 0) + n
        return out

    after_dedupe = sum(counts.values())
    source = {"path": input_csv}
    if manifest:
        digest = _one(io.dataset_digest(io.file_digests(spark, input_csv)))
        source |= {"sha256": digest["sha256"], "size_bytes": int(digest["size_bytes"])}
    # The keys of the manifest, an output contract.
    result = {
        "schema_version": "1.0",
        "created_at": datetime.now(timezone.utc).isoformat(),
        "tool": tool,
        "source": source,
        "splits": folder,
        "options": asdict(opts),
        "rows": {
            "loaded": int(checks["rows"]),
            "dropped_empty_text": blank if opts.drop_empty_text else 0,
            "truncated_text_rows": int(seen.get("truncated_rows", 0)),
            "after_normalize": after_normalize,
            "duplicates_removed": after_normalize - after_dedupe,
            "after_dedupe": after_dedupe,
            "train": sum(n for (s, _), n in counts.items() if s == "train"),
            "val": sum(n for (s, _), n in counts.items() if s == "val"),
            "test": sum(n for (s, _), n in counts.items() if s == "test"),
        },
        "label_counts": {"before_split": hist(), "train": hist("train"), "val": hist("val"), "test": hist("test")},
    }
    if manifest:
        io.write_manifest(spark, f"{output_dir}/split_manifest", result)
    return result
