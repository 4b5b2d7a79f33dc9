"""Labelled-data preparation.

* ``normalize`` strips Unicode whitespace, drops (or flags) blank rows and
  truncates, with the counts from the same scan.
* ``dedupe_text`` keeps the smallest key per distinct text (deterministic,
  unlike ``dropDuplicates``); partial aggregation reduces a hot text per
  map task before the shuffle.
* ``stratified_split`` is exact and distributed: quotas per class by
  largest remainder, rows ranked by ``md5(seed:key)`` inside their class.
  Ranking a class with one window would put each class in one task, so
  rows are bucketed by the first 4 hex digits of the hash; bucket counts
  (at most 65,536 per class, a proven bound) are prefix-summed, rows of
  buckets that fall wholly inside one split are assigned by a join with
  that small table, and only the rows of the <= 2 boundary buckets per class
  get a ``row_number``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ustrip
from ..session import checkpoint_dir

SPLITS = ("train", "val", "test")
#: Hex digits of the hash used for buckets: 16**4 = 65,536 buckets per class.
BUCKET_HEX = 4


def normalize(df: DataFrame, text_col: str = "text", drop_empty_text: bool = True,
              max_text_chars: int | None = None, observation=None) -> tuple[DataFrame, DataFrame]:
    """``(rows, stats)``.  ``rows`` has the stripped, truncated text and
    no blank rows when ``drop_empty_text``; otherwise blank rows stay and
    the stats row reports them (the caller fails the job on
    ``blank_rows > 0``).  ``stats`` is one row: ``rows_in, blank_rows,
    dropped_empty, truncated_rows, max_chars, rows_out``.

    With an ``Observation``, the counts ``rows_in, blank_rows,
    truncated_rows`` are also collected while ``rows`` is computed, so a job
    that writes ``rows`` needs no separate pass for the stats."""
    s = df.withColumn(text_col, ustrip(F.col(text_col).cast("string")))
    blank = F.length(text_col) == 0
    s = s.withColumn("__blank", blank)
    limit0 = max_text_chars if (max_text_chars is not None and max_text_chars > 0) else None
    if observation is not None:
        long0 = ((F.length(text_col) > limit0) & ~F.col("__blank")) if limit0 else F.lit(False)
        s = s.observe(observation, F.count(F.lit(1)).alias("rows_in"), F.count_if("__blank").alias("blank_rows"),
                      F.count_if(long0).alias("truncated_rows"))
    kept = s.filter(~F.col("__blank")) if drop_empty_text else s
    limit = max_text_chars if (max_text_chars is not None and max_text_chars > 0) else None
    if limit:
        long_ = (F.length(text_col) > limit) & ~F.col("__blank")
        rows = kept.withColumn(text_col, F.substring(text_col, 1, limit))
    else:
        long_ = F.lit(False)
        rows = kept
    stats = s.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if("__blank").alias("blank_rows"),
        (F.count_if("__blank") if drop_empty_text else F.lit(0)).cast("bigint").alias("dropped_empty"),
        F.count_if(long_).alias("truncated_rows"),
    ).withColumns({
        "max_chars": F.lit(limit).cast("int"),
        "rows_out": F.col("rows_in") - F.col("dropped_empty"),
    })
    return rows.drop("__blank"), stats


def dedupe_text(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """One row per distinct text, the one with the smallest key (which must
    be unique).  Texts meet by their SHA-256 digest; the keys of the others,
    usually few, are removed by an anti-join, so whole texts are neither
    grouped nor sorted."""
    h = F.coalesce(F.sha2(F.col(text_col), 256), F.lit(""))
    digests = df.select(F.col(key).alias("__key"), h.alias("__h"))
    first = digests.groupBy("__h").agg(F.min("__key").alias("__first"))
    losers = digests.join(first, "__h").where("__key <> __first").select("__key")
    return df.join(losers, df[key] == losers["__key"], "left_anti")


def label_histogram(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label, n)`` (sort when presenting)."""
    return df.groupBy(F.col(label_col).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def split_quotas(counts: DataFrame, fractions: tuple[float, float, float], label_col: str = "label") -> DataFrame:
    """Per-class ``(label, n, n_test, n_val)`` from ``(label, n)``.

    Totals: ``floor(N*f + 0.5)`` for test and validation; per class the
    integer share ``n_c*T div N`` plus one for the classes with the largest
    remainders ``n_c*T mod N`` (ties to the smaller label).  Works on the
    k-row count table only.
    """
    train, val, test = fractions
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"train + val + test must sum to 1.0, got {train + val + test}")
    all_w = Window.partitionBy(F.lit(1))
    c = counts.withColumn("__N", F.sum("n").over(all_w))
    for name, frac in (("test", test), ("val", val)):
        total = F.floor(F.col("__N") * F.lit(float(frac)) + F.lit(0.5)).cast("bigint")
        c = c.withColumn(f"__T_{name}", total)
        # n*T overflows a long past ~3e9 rows: exact decimal(38,0) arithmetic
        prod = F.col("n").cast("decimal(38,0)") * F.col(f"__T_{name}").cast("decimal(38,0)")
        big_n = F.col("__N").cast("decimal(38,0)")
        c = c.withColumn(f"__rem_{name}", prod % big_n)
        c = c.withColumn(f"__base_{name}", ((prod - F.col(f"__rem_{name}")) / big_n).cast("bigint"))
        c = c.withColumn(f"__rank_{name}", F.row_number().over(
            Window.partitionBy(F.lit(1)).orderBy(F.desc(f"__rem_{name}"), F.col(label_col))))
        left = F.col(f"__T_{name}") - F.sum(f"__base_{name}").over(all_w)
        c = c.withColumn(f"n_{name}", (F.col(f"__base_{name}") + F.when(F.col(f"__rank_{name}") <= left, 1)
                                       .otherwise(0)).cast("bigint"))
    c = c.withColumn("n_val", F.least(F.col("n_val"), F.col("n") - F.col("n_test")))
    return c.select(label_col, "n", "n_test", "n_val")


def split_hash(key: str, seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_split(df: DataFrame, key: str, label_col: str = "label",
                     fractions: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42,
                     min_class_rows: int = 3, num_labels: int = 4, tie: str | None = None) -> DataFrame:
    """H1: adds ``split`` in {train, val, test}.  Exact per-class sizes; the
    same input and seed always give the same assignment, at any
    partitioning.  Rows whose label is outside ``[0, num_labels)`` and all
    rows of classes with fewer than ``min_class_rows`` rows get
    ``split = null`` and ``split_error`` set (the job should fail on them).

    ``key`` must identify rows uniquely (``prepare`` uses a generated row
    id): rows sharing a key share a hash, so they would tie in the ranking
    and crowd one bucket.

    The input is read once for the bucket counts (per-class counts are sums
    of those; the bucket table is checkpointed, so this runs eagerly) and
    once per output branch (rows of whole buckets, rows of boundary
    buckets); pass a stored table when the input is expensive to compute.  The bucket table has at
    most 65,536 x ``num_labels`` rows by construction; the planner chooses the
    join from its measured size.

    With ``tie``, rows may share a key: they tie in the hash and are told apart
    by that column."""
    lab = F.col(label_col)
    in_range = lab.isNotNull() & (lab >= 0) & (lab < num_labels)
    rows = (df.withColumn("__h", split_hash(key, seed))
            .withColumn("__b", F.when(in_range, F.conv(F.substring("__h", 1, BUCKET_HEX), 16, 10).cast("int"))))
    buckets = (rows.filter(F.col("__b").isNotNull()).groupBy(label_col, "__b")
               .agg(F.count(F.lit(1)).alias("__bn")))
    counts = buckets.groupBy(label_col).agg(F.sum("__bn").alias("n"))
    quotas = split_quotas(counts, fractions, label_col)
    w = Window.partitionBy(label_col).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (buckets.withColumn("__start", F.coalesce(F.sum("__bn").over(w), F.lit(0)).cast("bigint"))
               .join(quotas, label_col))
    t1 = F.col("n_test")
    t2 = F.col("n_test") + F.col("n_val")
    start, end = F.col("__start"), F.col("__start") + F.col("__bn")
    buckets = buckets.withColumn(
        "__whole", F.when(end <= t1, F.lit("test")).when((start >= t1) & (end <= t2), F.lit("val"))
        .when(start >= t2, F.lit("train"))).withColumn("__small", F.col("n") < min_class_rows)
    # The bucket table is small (<= 65,536 x num_labels rows) but both union
    # branches below would re-aggregate the input for it: store it once in
    # the shared checkpoint folder.
    checkpoint_dir(df.sparkSession)
    bt = buckets.select(label_col, "__b", "__start", "__whole", "__small", "n_test", "n_val").checkpoint(eager=True)
    joined = rows.join(bt, [label_col, "__b"], "left")

    direct = joined.filter(F.col("__whole").isNotNull() | F.col("__b").isNull()).withColumn("split", F.col("__whole"))
    edge = joined.filter(F.col("__whole").isNull() & F.col("__b").isNotNull())
    pos = F.col("__start") + F.row_number().over(Window.partitionBy(label_col, "__b").orderBy("__h", tie or key)) - 1
    edge = edge.withColumn("__pos", pos).withColumn(
        "split", F.when(F.col("__pos") < F.col("n_test"), F.lit("test"))
        .when(F.col("__pos") < F.col("n_test") + F.col("n_val"), F.lit("val")).otherwise(F.lit("train"))).drop("__pos")
    out = direct.unionByName(edge)
    bad = F.col("__b").isNull()
    out = out.withColumns({
        "split": F.when(F.col("__small") | bad, F.lit(None).cast("string")).otherwise(F.col("split")),
        "split_error": F.when(bad, F.lit(f"label outside [0, {num_labels})"))
        .when(F.col("__small"), F.lit(f"class has fewer than {min_class_rows} rows")),
    })
    return out.drop("__h", "__b", "__start", "__whole", "__small", "n_test", "n_val")


def split_counts(split_df: DataFrame, label_col: str = "label") -> DataFrame:
    """H3 counts: ``(split, label, n)``."""
    return split_df.groupBy("split", F.col(label_col).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def leak_check(split_df: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts present in more than one split (must be empty after dedupe):
    ``(text_sha256, n_splits)``.  One partial aggregate on the digest."""
    return (split_df.groupBy(F.sha2(F.col(text_col), 256).alias("text_sha256")).agg(F.countDistinct("split").alias("n_splits"))
            .filter(F.col("n_splits") > 1))


def manifest_counts(split_df: DataFrame, label_col: str = "label") -> DataFrame:
    """One row with row counts per split and the four label histograms
    as ``map<string,bigint>`` (keys sorted).  One grouped pass on
    ``(split, label)``; the result has at most 3*k rows before folding."""
    sc = split_counts(split_df, label_col)
    hist = (sc.groupBy("split")
            .agg(F.sum("n").alias("rows"),
                 F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label").cast("string"), "n"))))
                 .alias("label_counts")))
    before = (sc.groupBy("label").agg(F.sum("n").alias("n"))
              .agg(F.sum("n").alias("rows"),
                   F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label").cast("string"), "n"))))
                   .alias("label_counts"))
              .withColumn("split", F.lit("before_split")))
    return hist.unionByName(before)
