"""Exact membership of narrow keys by a cascade of Bloom filters.

A Bloom filter of the members has false positives among the others.  Where all
others are known too, those false positives get a filter of their own, its
false positives among the members the next one, and so on until none is left:
a test that is exact for every key that was known, at about ten bits a member.
It is what lets a task decide on its own rows without moving them.

Keys are pairs of longs (two hashes of a digest), so that keys meet by chance
only at 128 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

BITS_PER_KEY = 10
PROBES = 7
#: A cascade's filters together; larger ones are not built.
FILTER_BYTES = 32 << 20
#: 64-bit words that go into the plan as literals, tested in the JVM; larger
#: filters are broadcast and tested on Arrow batches.
LITERAL_WORDS = 1 << 16
_MAX_LEVELS = 40


def key_pair(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns."""
    return [F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second"), *cols).alias("b")]


def _filter_bits(keys: DataFrame, n: int) -> np.ndarray:
    """Bits of a Bloom filter over ``keys`` (a, b), as 64-bit words."""
    words = max(16, -(-n * BITS_PER_KEY // 64))
    size = words * 64
    step = F.pmod("b", F.lit(size - 1)) + 1
    at = F.explode(F.array(*((F.pmod("a", F.lit(size)) + i * step) % size for i in range(PROBES))))
    bits = keys.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out


def _hits(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = len(words) * 64
    at, step = a % size, b % (size - 1) + 1     # numpy's % is pmod
    found = np.ones(len(a), bool)
    for i in range(PROBES):
        p = (at + i * step) % size
        found &= (words[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return found


def _member(levels, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys are members: decided by the first filter that misses."""
    out = np.zeros(len(a), bool)
    live = np.arange(len(a))
    for depth, words in enumerate(levels):
        hit = _hits(words, a[live], b[live])
        out[live[~hit]] = depth % 2 == 1
        live = live[hit]
    out[live] = len(levels) % 2 == 1
    return out


def _literal_hit(words: np.ndarray, a: Column, b: Column) -> Column:
    size = len(words) * 64
    table = F.from_json(F.lit(str(words.view(np.int64).tolist())), "array<bigint>")
    at, step = F.pmod(a, F.lit(size)), F.pmod(b, F.lit(size - 1)) + 1
    places = [(at + i * step) % size for i in range(PROBES)]
    bits = [F.getbit(F.get(table, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in places]
    out = bits[0]
    for bit in bits[1:]:
        out = out & bit
    return out


class Cascade:
    """Filters, outermost first, as a test on (a, b) columns."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels

    def test(self, spark, a: Column, b: Column, literal_words: int = LITERAL_WORDS) -> Column:
        if sum(map(len, self.levels)) <= literal_words:
            out = F.lit(False)
            for words in reversed(self.levels):
                out = _literal_hit(words, a, b) & ~out
            return out
        shared = spark.sparkContext.broadcast(self.levels)

        @F.pandas_udf("boolean")
        def member(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(_member(shared.value, x.to_numpy(np.int64), y.to_numpy(np.int64)))

        return member(a, b)


def cascade(members: DataFrame, others: DataFrame, max_bytes: int = FILTER_BYTES) -> Cascade | None:
    """The exact filter of ``members`` (a, b) against ``others``; both distinct,
    and no key in both.  None where the members are too many for ``max_bytes``."""
    spark = members.sparkSession
    inside, outside = members, others
    levels: list[np.ndarray] = []
    while len(levels) < _MAX_LEVELS:
        n = inside.count()
        if n == 0 and levels:
            return Cascade(levels)
        if sum(x.nbytes for x in levels) + n * BITS_PER_KEY // 8 > max_bytes:
            return None
        levels.append(_filter_bits(inside, n))
        path = scratch_path(spark, "cascade")
        outside.where(Cascade(levels[-1:]).test(spark, F.col("a"), F.col("b"))).write.parquet(path)
        inside, outside = spark.read.parquet(path), inside
    raise ValueError("two keys share their hashes")
