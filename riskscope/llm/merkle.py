"""Merkle manifest (operator 11): slot pivot.

Leaves are numbered within their tree; a parent is the group of ``fanout``
consecutive nodes.  Conditional aggregates spread its children into one column
a slot; all columns concatenated give its hash, and all but a child's own
column give that child's siblings.

Levels are climbed in bands: the ``fanout ** band`` nodes below one node of the
band's top are shuffled together once, and all levels between are aggregates
within that partition.  A block is bounded, so a tree that holds every row is
as well dealt as many small ones.  Each band's rows are written to the shared
folder; the way down joins a block with the steps above it, one row on each
side of the key.

A step of a path is what stands left and right of the carried hash, so folding
a leaf is a fold over its steps.

Nulls: a null in any hashed column is ``-``; a null tree key is a tree of its
own and comes first; a null doc_id sorts first and is never tampered with.
Rows that share a doc_id are ordered by their leaf hash; repeated rows are
repeated leaves.  Empty texts count as ``0:``.  An empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskscope.llm.common import stored
from riskscope.session import scratch_path

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
BAND = 256   # nodes below one node of a band's top, at most
_STEPS = "array<struct<left:string,right:string>>"


def leaf_hash(values: list[Column]) -> Column:
    """Hex sha256 of the values, each with its UTF-8 byte count before it."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 within ``tree``, by ``order``) and ``n``
    (rows of the tree): the start of a (file, tree) piece of a range-sorted
    table plus the place in the file."""
    spark = rows.sparkSession
    path = scratch_path(spark, "merkle-order")
    (rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "__tie").drop("__tie")
         .sortWithinPartitions("tree", *order).write.parquet(path))
    back = spark.read.schema(rows.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    key = F.struct(*order)
    pieces = back.groupBy("__file", "tree").agg(
        F.count("*").alias("size"), F.min("__row").alias("first"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("lo", "hi", "__file").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("__file", "tree", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("start"),
                           F.sum("size").over(tree).alias("n"))
    return back.join(pieces, ["__file", "tree"]).withColumn("pos", F.col("start") + F.col("__row")).drop(
        "__file", "__row", "start")


def _band(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The nodes ``levels`` above: tree, pos, n, hash, and ``members``, the
    nodes below with their steps.  A tree of one node is left as it is."""
    none = F.array().cast(_STEPS)
    rows = nodes.select(
        "tree", F.expr(f"pos div {fanout ** levels}").alias("block"), "pos", "n", "hash",
        F.array(F.struct("item", none.alias("steps"))).alias("members")).repartition("tree", "block")
    for _ in range(levels):
        slot = F.col("pos") % fanout
        rows = rows.groupBy("tree", "block", F.col("n").alias("below"), F.expr(f"pos div {fanout}").alias("up")).agg(
            *(F.max(F.when(slot == s, F.col("hash"))).alias(f"h{s}") for s in range(fanout)),
            *(F.first(F.when(slot == s, F.col("members")), ignorenulls=True).alias(f"m{s}") for s in range(fanout)))
        hashes = [F.col(f"h{s}") for s in range(fanout)]
        grows = F.col("below") > 1

        def climbed(s: int) -> Column:
            text = lambda cols: F.concat_ws("", *cols) if cols else F.lit("")
            step = F.array(F.struct(text(hashes[:s]).alias("left"), text(hashes[s + 1:]).alias("right")))
            return F.coalesce(F.transform(f"m{s}", lambda m: F.struct(
                m["item"].alias("item"), F.when(grows, F.concat(m["steps"], step)).otherwise(m["steps"]).alias("steps"))),
                F.array())

        rows = rows.select(
            "tree", "block", F.col("up").alias("pos"), F.expr(f"(below + {fanout - 1}) div {fanout}").alias("n"),
            F.when(grows, F.sha2(F.concat_ws("", *hashes), 256)).otherwise(hashes[0]).alias("hash"),
            F.concat(*(climbed(s) for s in range(fanout))).alias("members"))
    return rows.select("tree", "pos", "n", "hash", "members")


def _climb(nodes: DataFrame, fanout: int, block: int) -> list[DataFrame]:
    """The bands over ``nodes`` (tree, pos, n, hash, item), lowest first; the
    last one has a row a tree."""
    bands = []
    while True:
        most = nodes.agg(F.max("n")).first()[0] or 1
        levels = 1
        while fanout ** levels < most and fanout ** (levels + 1) <= block:
            levels += 1
        bands.append(stored(_band(nodes, fanout, levels), "merkle-band"))
        if fanout ** levels >= most:
            return bands
        nodes = bands[-1].select("tree", "pos", "n", "hash", F.struct("pos").alias("item"))


def _descend(bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """(item, steps, root, subroot) of what the lowest band was built from;
    ``above`` has tree, steps, root and subroot."""
    above = above.withColumn("pos", F.lit(0).cast("long"))
    for band in reversed(bands):
        rows = band.join(above, ["tree", "pos"]).select("tree", "root", "subroot", "steps", F.explode("members").alias("m"))
        rows = rows.select("tree", "root", "subroot", F.col("m.item").alias("item"),
                           F.concat("m.steps", "steps").alias("steps"))
        above = rows.select("tree", "root", "subroot", "steps", F.col("item.pos").alias("pos")) if band is not bands[0] else rows
    return above.select("item", "steps", "root", "subroot")


def paths(leaves: DataFrame, order: list[str], fanout: int = FANOUT, block: int = BAND) -> DataFrame:
    """For leaves (tree, hash, item): item, subroot, root and the steps from
    the leaf to the root.  Within a tree leaves stand by ``order``; the trees'
    roots, by tree, are the leaves of the last tree."""
    if fanout < 2 or block < fanout:
        raise ValueError("fanout must be 2 or more, and a block hold one parent's children at least")
    bands = _climb(numbered(leaves, order), fanout, block)
    tops = bands[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash")
    crown = _climb(numbered(tops, ["of"]).withColumn("item", F.struct("of", "hash")), fanout, block)
    root = crown[-1].select("tree", F.col("hash").alias("root"), F.lit(None).cast("string").alias("subroot"),
                            F.array().cast(_STEPS).alias("steps"))
    above = _descend(crown, root).select(F.col("item.of").alias("tree"), "steps", "root", F.col("item.hash").alias("subroot"))
    return _descend(bands, above)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf hash and its steps lead to."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(steps: Column) -> Column:
    """The siblings from the leaf to the root, concatenated."""
    return F.concat_ws("", F.flatten(F.transform(steps, lambda s: F.array(s["left"], s["right"]))))


def manifest(docs: DataFrame, fanout: int = FANOUT, block: int = BAND) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one
    tree a language.  Rows whose doc_id's crc32 is divisible by 7 are checked
    with one added to n_chars, as a tampered copy would be."""
    values = {c: F.col(c) for c in LEAF_COLUMNS}
    more = values | {"n_chars": F.col("n_chars") + 1}
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(list(values.values())).alias("hash"),
        F.when(hit, leaf_hash(list(more.values()))).alias("changed"))
    leaves = stored(rows, "merkle-leaves").withColumn("item", F.struct("doc_id", "hash", "changed"))
    found = paths(leaves, ["doc_id", "hash"], fanout, block)
    folded = found.select(
        F.col("item.doc_id").alias("doc_id"), F.col("item.hash").alias("leaf"), "subroot", "root",
        F.sha2(proof(F.col("steps")), 256).alias("proof_sha256"),
        fold(F.coalesce("item.changed", "item.hash"), F.col("steps")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
