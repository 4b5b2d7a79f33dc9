"""Helpers shared by the training-data operators: column selection, shared
scratch tables, and vectorised hashes of word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscope.session import scratch_path

# Any odd multiplier has an inverse modulo 2**64, which is what lets a range
# hash be read off two prefix sums.
_RADIX = 0x9E3779B97F4A7C15
_RADIX_INV = pow(_RADIX, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
PIECE_BYTES = 2 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, under fixed names: other columns, whatever
    they are called, never meet the operator's own."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def stored(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts
    the lineage, and survives the loss of executors.  The shuffle files of the
    write are of no more use and go at once.  ``batch_bytes`` bounds what goes to
    a Python worker at a time."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    conf = {_CLEANUP: "true"} | ({_BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, radix in (("up", _RADIX), ("down", _RADIX_INV)):
            steps = np.full(size, radix, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
        _POWERS["bytes"] = np.random.Generator(np.random.PCG64(20240901)).integers(
            1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHash:
    """64-bit hashes of byte ranges of one buffer: equal bytes give equal
    hashes wherever they stand."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        up, self._down = _powers(len(raw) + 1)
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_POWERS["bytes"][raw] * up[: len(raw)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a text whose words are joined by
    single spaces."""
    if not joined:
        empty = np.zeros(0, np.int64)
        return empty, empty
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every run of ``width`` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    span, acc = 1, values
    while span * 2 <= width:
        acc = pick(acc[:-span], acc[span:])
        span *= 2
    return pick(acc[:n], acc[width - span:width - span + n])


def pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``limit`` bytes of one string column, so that
    what a task makes of its rows is never as large as a whole batch's."""
    values = batch.column(column)
    if len(batch) < 2 or values.nbytes <= limit:
        yield batch
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(values.cast(pa.binary())), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
