"""Scans and sinks.

Readers return DataFrames and read files in splits (quoted CSV, JSON Lines,
text); only a JSON array is one value.  Writers are plain
DataFrame writes; the manifest and digests are small one-row frames.
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ustrip
from ..params import CSV_NULL_TOKENS
from ..session import scratch_path
from .lines import FILE, ROW, SPLIT, placed, read_csv, with_dense_index

REQUIRED_COLUMNS = ("text", "label")
TEXT_FORMATS = (".json", ".jsonl", ".txt")


# --------------------------------------------------------------------------
# S1 labelled CSV
# --------------------------------------------------------------------------

def invalid_utf8_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``path`` that are not valid UTF-8.  ``spark.read.text``
    keeps the raw bytes (the CSV reader would silently replace them), so
    this is a splittable per-line check."""
    return spark.read.text(path).filter(~F.is_valid_utf8("value"))


def load_labeled_csv(spark: SparkSession, path: str, strict_utf8: bool = True, splittable: bool = True,
                     null_tokens: tuple[str, ...] = CSV_NULL_TOKENS) -> DataFrame:
    """Header CSV, UTF-8 (a leading BOM is dropped), ``"``-quoted with
    ``""`` escapes and line breaks inside quotes, all columns as strings, then
    the usual null tokens (``NA``, ``null``, ...) turned into nulls.

    A file is read in splits, its records stitched together by the parity of
    their quotes (``lines.read_csv``).  That takes quotes to stand at a field's
    ends alone; ``splittable=False`` takes Spark's own reader, one task a file,
    which also accepts a quote within an unquoted field and lone ``\\r`` line
    ends.  ``strict_utf8`` fails on any invalid byte sequence.
    """
    if splittable:
        df = read_csv(spark, path, strict_utf8)
    else:
        wrong = invalid_utf8_lines(spark, path).count() if strict_utf8 else 0
        if wrong:
            raise ValueError(f"{path}: {wrong} lines hold bytes that are not UTF-8")
        df = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
              .option("escape", '"').option("encoding", "UTF-8").csv(path))
    tokens = list(null_tokens)
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in df.columns}
    return df.select(*[F.when(v.isin(tokens), F.lit(None).cast("string")).otherwise(v).alias(c) for c, v in quoted.items()])


def require_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}: {len(missing)} missing")


# --------------------------------------------------------------------------
# S2-S5 text inputs
# --------------------------------------------------------------------------

_CORRUPT = "_corrupt_record"
_JSON_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("content", T.StringType()),
                             T.StructField(_CORRUPT, T.StringType())])


def _json_array_items(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """The elements of files that hold one JSON array each (or one object),
    parsed one by one: an element that is no object is one malformed item.  A
    file is one value, 2 GB at most, for one task."""
    files = spark.read.option("wholetext", True).text(path)
    files = files.select("value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(SPLIT))
    many = F.from_json("value", "array<variant>", {"mode": "PERMISSIVE"})
    one = F.array(F.try_parse_json("value"))
    items = files.select(FILE, SPLIT, "value", F.when(F.ltrim("value").startswith("["), many).otherwise(one).alias("v"))
    items = items.select(FILE, SPLIT, F.explode(F.when(F.col("v").isNull(), F.array(F.lit(None).cast("variant")))
                                                .otherwise(F.col("v"))).alias("v"),
                         F.when(F.col("v").isNull(), F.col("value")).alias("whole"))
    # null for what is no object; the text of a null element is 'null'
    kind = F.schema_of_variant("v")
    fine = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    field = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    bad = F.when(~fine, F.coalesce("whole", F.to_json("v"), F.lit("null")))
    if strict:
        bad = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("no JSON object: "), F.left(bad, F.lit(100)))).cast("string"))
    return items.select(FILE, SPLIT, F.when(fine, F.coalesce(field("text"), field("content"), F.lit(""))).alias("text"),
                        bad.alias("malformed")).withColumn(ROW, F.monotonically_increasing_id())


def read_texts(spark: SparkSession, path: str, fmt: str | None = None, strict: bool = False) -> DataFrame:
    """``(item_idx, text, malformed)`` from ``.json`` (an array of objects
    a file), ``.jsonl`` or ``.txt`` (one text per line, stripped, blank lines
    dropped).  For JSON the text is ``text``, else ``content``, else ``''``
    (an explicit ``"text": null`` also falls through to ``content``).
    ``item_idx`` numbers the items from 0 in the order of the input (files by
    path), for any number of partitions.  ``malformed`` holds the source of a
    record that is no JSON object, whose text is null; the others of its array
    or file are read.  With ``strict`` such a record fails the read.
    Other suffixes are an error."""
    suffix = fmt or PurePosixPath(path.rstrip("/")).suffix
    if suffix not in TEXT_FORMATS:
        raise ValueError(f"cannot read {suffix or path!r}: known formats are {', '.join(TEXT_FORMATS)}")
    if suffix == ".json":
        return with_dense_index(_json_array_items(spark, path, strict)).select("item_idx", "text", "malformed")
    place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(SPLIT)]
    if suffix == ".txt":
        df = spark.read.text(path).select(*place, ustrip("value").alias("text")).filter(F.length("text") > 0)
        df = df.withColumn("malformed", F.lit(None).cast("string"))
    else:
        reader = spark.read.schema(_JSON_SCHEMA).option("mode", "FAILFAST" if strict else "PERMISSIVE")
        df = reader.option("columnNameOfCorruptRecord", _CORRUPT).json(path).select(
            *place, F.when(F.col(_CORRUPT).isNull(), F.coalesce("text", "content", F.lit(""))).alias("text"),
            F.col(_CORRUPT).alias("malformed"))
    return with_dense_index(df.withColumn(ROW, F.monotonically_increasing_id())).select("item_idx", "text", "malformed")


# --------------------------------------------------------------------------
# S7-S11, S14 sinks
# --------------------------------------------------------------------------

def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S7 (and S9/S10 with ``mode='append'``: append-only JSON Lines logs)."""
    df.write.mode(mode).json(path)


def write_results_csv(results: DataFrame, path: str, key: str = "doc_id") -> None:
    """The CSV view of results, with a header."""
    from ..plans.classify import csv_view
    csv_view(results, key).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_splits(split_df: DataFrame, path: str) -> None:
    """One write partitioned by ``split`` instead of three passes."""
    (split_df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .partitionBy("split").csv(path))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Read back ``write_splits`` output (quoted, multi-line texts)."""
    return (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", '"').csv(path))


# --------------------------------------------------------------------------
# S12 digests, S13 manifest
# --------------------------------------------------------------------------

#: ``binaryFile`` holds a file as one value, which Spark bounds at 2 GB.
WHOLE_FILE_BYTES = 2**31 - 1
#: Nodes below one node of a large file's digest tree.
DIGEST_FANOUT = 4096


def file_digests(spark: SparkSession, path: str, whole_file_bytes: int = WHOLE_FILE_BYTES,
                 fanout: int = DIGEST_FANOUT) -> DataFrame:
    """``(path, sha256, size_bytes, kind)`` per file under ``path``.  Up to
    ``whole_file_bytes`` the digest is the file's own (kind ``file``).

    A larger file is read by lines, in splits (kind ``lines``): the digests of
    its lines are the leaves of a tree whose nodes hash the hex digests of
    ``fanout`` consecutive nodes below, until one is left; the file's digest is
    that of ``size:lines:root``.  It depends on the lines in order, and by the
    size on whether the last one ends, but not on how the file is cut.  A file
    that has no digest in the end raises."""
    files = spark.read.format("binaryFile").load(path).select("*", F.col("_metadata.file_path").alias(FILE))
    # The length alone is read for files that are too large as one value.
    small = files.filter(F.col("length") <= whole_file_bytes).select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.lit("file").alias("kind"))
    large = files.filter(F.col("length") > whole_file_bytes).select("path", F.col("length").alias("size_bytes"), FILE)
    names = [r[0] for r in large.select(FILE).limit(1).collect()]
    if not names:
        return small
    lines = placed(spark.read.option("lineSep", "\n").text(path)).join(
        large.select(FILE), FILE, "left_semi").select(FILE, SPLIT, ROW, F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))
    first = lines.groupBy(FILE, SPLIT).agg(F.min(ROW).alias("first"), F.count(F.lit(1)).alias("n"))
    per_file = Window.partitionBy(FILE)
    before = per_file.orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(FILE, SPLIT, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("add"),
                         F.sum("n").over(per_file).alias("lines"))
    nodes = lines.join(first, [FILE, SPLIT]).select(FILE, "lines", (F.col("add") + F.col(ROW)).alias("pos"), F.col("lines").alias("left"), "sha256")
    most = first.agg(F.max("lines")).first()[0]
    while most > 1:
        path_ = scratch_path(spark, "digest-tree")
        node = F.sha2(F.array_join(F.col("below.sha256"), ""), 256)
        (nodes.groupBy(FILE, "lines", "left", F.expr(f"pos div {fanout}").alias("up"))
         .agg(F.sort_array(F.collect_list(F.struct("pos", "sha256"))).alias("below"))
         .select(FILE, "lines", F.col("up").alias("pos"), F.expr(f"(left + {fanout - 1}) div {fanout}").alias("left"),
                 F.when(F.col("left") > 1, node).otherwise(F.col("below.sha256")[0]).alias("sha256"))
         .write.parquet(path_))
        nodes, most = spark.read.parquet(path_), -(-most // fanout)
    roots = nodes.select(FILE, "lines", F.col("sha256").alias("root"))
    digest = F.sha2(F.concat_ws(":", "size_bytes", "lines", "root"), 256)
    found = F.when(F.col("root").isNotNull(), digest).otherwise(
        F.raise_error(F.concat(F.lit("no line was read of "), F.col("path"))).cast("string"))
    return small.unionByName(large.join(roots, FILE, "left").select("path", found.alias("sha256"), "size_bytes",
                                                                    F.lit("lines").alias("kind")))


def dataset_digest(digests: DataFrame) -> DataFrame:
    """One row: total size, file count and a digest.  For a single file it is
    the file's own; for several, that of the sums of the parts of each
    ``path:sha256`` digest, so no list of paths is gathered."""
    h = F.sha2(F.concat_ws(":", "path", "sha256"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    return digests.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("size_bytes"),
        F.when(F.count(F.lit(1)) == 1, F.first("sha256")).otherwise(F.sha2(F.concat_ws(":", *parts), 256)).alias("sha256"),
    )


def manifest_json(manifest: dict) -> str:
    """Sorted keys, two-space indent, trailing newline."""
    return json.dumps(manifest, indent=2, sort_keys=True) + "\n"


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write the manifest as one JSON text file (a one-row frame)."""
    spark.createDataFrame([(manifest_json(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(path)
