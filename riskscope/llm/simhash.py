"""SimHash near-duplicates (operator 12): meet-in-the-middle ball hashing.

A fingerprint has a bit set where over half of a text's shingle hashes have it.
Two fingerprints at ``RADIUS`` = 3 or fewer differing bits have one in the
middle: within 1 bit of the one and 2 of the other.  Each fingerprint emits
the variants within half the radius, and fingerprints that share a variant
are linked.

- Rounding up is needed at distance 3 alone, and only on one side: two
  fingerprints at an odd distance differ in parity, so only those of even
  parity emit variants at 2 bits.
- Of three differing bits two lie in the same half of the fingerprint, so
  variants at 2 bits flip two bits of one half.
- A variant that nobody else can emit is left out before the shuffle of
  variants: its unflipped half must be the half, or a half one bit away, of
  another fingerprint.  That takes 66 narrow rows a fingerprint, not some 560.

In the group of a variant, those within 1 bit of it are within 3 of all
others, so the group is a star round the least of them: no pairs are listed.
A group has at most 1 + 64 + 2016 members.  Links are verified and made
distinct, and star steps join them to components.

Words: maximal runs without ASCII white space, A-Z lower-cased; shingles of 3
words, repeats included; fewer words are one shingle; none give fingerprint 0,
which links like any other.  Null texts have no words.  A null doc_id has its
row, connects others like any row, and is never the smallest while there is
another; a component of null ids alone has a null component_id.  Repeated rows
are returned each.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import keyed_text, stored, word_bounds
from riskscope.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3          # fixed by the contract; the scheme above is for 3
HALF = 32
CHUNK = 1 << 14     # shingles counted at once


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    joined = b" ".join((text or b"").lower().split())
    starts, ends = word_bounds(joined)
    if not len(starts):
        return 0
    width = min(SHINGLE, len(starts))
    starts, ends = starts[: len(starts) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            marks = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], schema=schema)

    return keyed_text(docs).mapInArrow(scan, "doc_id long, fp long")


_BALL = "concat(array(own), transform(sequence(0, 31), i -> own ^ shiftleft(1L, i)))"
_FLIPS = ("concat(array(0L), flatten(transform(sequence(0, 31), i -> transform(sequence(i, if(even, 31, i)), "
          "j -> shiftleft(1L, i) | shiftleft(1L, j)))))")


def links(marks: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``marks``'
    distinct fingerprints (fp) with at most 3 differing bits."""
    low = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    high = F.shiftrightunsigned("fp", HALF)
    halves = marks.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), low.alias("own")), F.struct(F.lit(HALF).alias("half"), high.alias("own")))).alias("h"))
    visits = halves.select("fp", "h.half", "h.own").select("fp", "half", "own", F.expr(f"explode({_BALL})").alias("key"))
    # Where two may meet: a fingerprint at home there, and any other one.
    places = (visits.groupBy("half", "key")
              .agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.max(F.col("key") == F.col("own")).alias("home"))
              .where("home and lo <> hi").select("half", "key"))
    met = visits.join(stored(places, "simhash-places"), ["half", "key"])
    # At home the other half is flipped; a visitor has flipped its one bit.
    home = F.col("key") == F.col("own")
    flips = F.when(home, F.expr(f"transform({_FLIPS}, m -> shiftleft(m, {HALF} - half))")).otherwise(
        F.array(F.expr("shiftleft(key ^ own, half)")))
    variants = met.withColumn("even", F.bit_count("fp") % 2 == 0).select("fp", F.explode(flips).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp", (F.bit_count("flip") <= 1).alias("near"))
    groups = variants.groupBy("variant").agg(
        F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.collect_set("fp").alias("fps")).where(
        "hub is not null and size(fps) > 1")
    return groups.select("hub", F.explode("fps").alias("fp")).where(
        (F.col("fp") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS)).select(
        F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per document."""
    rows = stored(fingerprints(docs), "simhash-rows")
    # Small rows that become 66 each: as many files as shuffle partitions.
    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).repartition(files, "fp"), "simhash-marks")
    roots = stored(components(links(marks)), "simhash-roots")
    placed = marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labels = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(labels, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
