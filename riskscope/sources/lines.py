"""Lines, items and records of files in their order, read in splits.

Rows of a split come in file order, so (file, start of the split, running
number) orders all rows.  What a row needs to know of the rows before it (its
number, whether a quote is open) is a sum over the splits before its own: one
small row a split, added up without any one task seeing all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

FILE, SPLIT, ROW = "__file", "__split", "__row"

#: Splits whose table (about 200 bytes each) may be sent to every task.
BROADCAST_SPLITS = 250_000


def placed(scan: DataFrame) -> DataFrame:
    """Rows of a file scan with the place they stand at.  Call it on the scan
    itself: filters that come after leave gaps in ``ROW``."""
    return scan.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(SPLIT)).withColumn(
        ROW, F.monotonically_increasing_id())


def sums_before(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` (stored) with the sum of ``value`` over all rows before, by
    ``order``.  Range partitions are summed first, so the only window over
    everything has a row a partition."""
    path = scratch_path(rows.sparkSession, "sums-before")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("__part"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = back.groupBy("__part").agg(F.sum(value).alias("__sum"))
    parts = parts.select("__part", F.coalesce(F.sum("__sum").over(up_to(Window.orderBy("__part"))), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum(value).over(up_to(Window.partitionBy("__part").orderBy(*order))), F.lit(0))
    return back.withColumn("__inner", inner).join(parts, "__part").withColumn(out, F.col("__base") + F.col("__inner")).drop(
        "__part", "__inner", "__base")


def with_dense_index(rows: DataFrame, out: str = "item_idx") -> DataFrame:
    """``placed`` rows numbered from 0 in the order of file path, split and
    place in the split, whatever the number of partitions.  Two scans; the
    table of splits meets the rows by a join that moves them only if it is too
    large to broadcast."""
    splits = rows.groupBy(FILE, SPLIT).agg(F.min(ROW).alias("__first"), F.count(F.lit(1)).alias("__n"))
    starts = sums_before(splits, [FILE, SPLIT], "__n", "__before").select(
        F.col(FILE).alias("__f"), F.col(SPLIT).alias("__s"), (F.col("__before") - F.col("__first")).alias("__add"))
    same = (F.col(FILE) == F.col("__f")) & (F.col(SPLIT) == F.col("__s"))
    return rows.join(starts, same).withColumn(out, F.col("__add") + F.col(ROW)).drop(FILE, SPLIT, ROW, "__f", "__s", "__add")


# --------------------------------------------------------------------------
# Quoted CSV records
# --------------------------------------------------------------------------

#: A record whose line breaks all stand in quoted fields.
_FIELD = r'(?:[^",\n\r]*|"[^"]*(?:""[^"]*)*")'
_RECORD = re.compile(rf"{_FIELD}(?:,{_FIELD})*")
_PIECES = pa.schema([(FILE, pa.string()), ("origin", pa.int64()), (SPLIT, pa.int64()), ("record", pa.string()),
                     ("partial", pa.bool_()), ("head", pa.bool_())])


def _check_record(record: str, file: str) -> None:
    if not _RECORD.fullmatch(record.removesuffix("\r")):
        raise ValueError(f"{file}: a quote inside an unquoted field at {record[:60]!r}; read it with splittable=False")


def _stitched(lines: DataFrame) -> DataFrame:
    """Records (and, as ``partial``, the pieces of those that cross a split's
    edge) of lines in order; ``__open`` says whether the line's split begins
    inside a quoted field, ``__origin`` in which split that record began.
    ``head`` marks the first record of a file."""

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, is_open, origin, head = None, [], False, 0, False

        def cut(partial: bool) -> tuple:
            nonlocal held, head
            record, first = "\n".join(held), head
            if len(held) > 1 and not partial:
                _check_record(record, at[0])
            head = head and record in ("", "\r")
            held = []
            return at[0], origin, at[1], record, partial, first and not head

        for batch in batches:
            out: list[tuple] = []
            for file, split, line, opens, before in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, split) != at:
                    if held:
                        out.append(cut(True))
                    at, is_open, origin, head = (file, split), opens, before if opens else split, split == 0
                held.append(line)
                is_open ^= bool(line.count('"') & 1)
                if not is_open:
                    out.append(cut(origin != split))
                    origin = split
            yield _as_batch(out)
        if held:
            yield _as_batch([cut(True)])

    return lines.select(FILE, SPLIT, "value", "__open", "__origin").mapInArrow(
        stitch, f"{FILE} string, origin long, {SPLIT} long, record string, partial boolean, head boolean")


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_PIECES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _check_record(record, file)
        yield batch


def csv_records(spark: SparkSession, path: str, strict_utf8: bool = True,
                broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """(file, record, head) of CSV files: quoted fields may hold line breaks,
    and files are read in splits all the same.

    A line with an odd number of quotes opens or closes a quoted field.  The
    parity of each split, added up over the splits before, tells whether a
    split begins inside one.  Only records that cross a split's edge are moved,
    to be joined.  A file whose quotes do not pair raises ValueError, and so do,
    with ``strict_utf8``, bytes that are not UTF-8.
    """
    lines = placed(spark.read.option("lineSep", "\n").text(path))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    splits = lines.groupBy(FILE, SPLIT).agg(
        F.count_if(odd).alias("odd"), F.min(F.when(odd, F.col(ROW))).alias("first"), F.max(ROW).alias("last"),
        F.count_if(~F.is_valid_utf8("value")).alias("bytes"))
    before = Window.partitionBy(FILE).orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    # An open split has a record that begins in it if its first odd line is not its last.
    begins = ~F.col("__open") | F.coalesce(F.col("first") < F.col("last"), F.lit(False))
    splits = splits.withColumn("__origin", F.coalesce(
        F.last(F.when(begins, F.col(SPLIT)), ignorenulls=True).over(before), F.lit(0).cast("long")))
    table = scratch_path(spark, "csv-splits")
    splits.select(FILE, SPLIT, "odd", "bytes", "__open", "__origin").write.parquet(table)
    splits = spark.read.parquet(table)
    n, wrong = splits.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    if strict_utf8 and wrong:
        raise ValueError(f"{path}: {wrong} lines hold bytes that are not UTF-8")
    unpaired = splits.groupBy(FILE).agg(F.sum("odd").alias("odd")).where("odd % 2 = 1").first()
    if unpaired:
        raise ValueError(f"{unpaired[FILE]}: the quotes do not pair")
    splits = splits.drop("odd", "bytes")
    if n <= broadcast_splits:
        known = lines.join(F.broadcast(splits), [FILE, SPLIT])   # the lines stay where they are, in order
    else:
        known = lines.join(splits, [FILE, SPLIT]).repartition(FILE, SPLIT).sortWithinPartitions(FILE, SPLIT, ROW)
    pieces = _stitched(known)
    # At most two pieces a split: one more scan costs less than storing all records.
    crossing = pieces.where("partial").groupBy(FILE, "origin").agg(
        F.sort_array(F.collect_list(F.struct(SPLIT, "record"))).alias("p"), F.bool_or("head").alias("head")).select(
        FILE, F.array_join(F.col("p.record"), "\n").alias("record"), "head")
    whole = pieces.where("not partial").select(FILE, "record", "head")
    return whole.unionByName(crossing.mapInArrow(_checked, crossing.schema))


def read_csv(spark: SparkSession, path: str, strict_utf8: bool = True) -> DataFrame:
    """Header CSV in splits, all columns strings: ``"``-quoted with ``""``
    escapes; records end with ``\\n`` or ``\\r\\n``; empty lines, and a BOM, are
    dropped.  Every file's first record is its header; the names are the first
    file's."""
    names = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).columns
    records = csv_records(spark, path, strict_utf8).where("not head").select(
        F.regexp_replace("record", "\r\\z", "").alias("record")).where("record <> ''")
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    row = F.from_csv("record", ddl, {"quote": '"', "escape": '"', "multiLine": "true"})
    # A generator keeps the optimizer from parsing the record once a column.
    return records.select(F.explode(F.array(row)).alias("r")).select("r.*")
