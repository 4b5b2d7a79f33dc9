"""Benchmark decontamination (operator 6): winnowing.

Every window of ``WINDOW`` consecutive word k-gram hashes keeps its smallest
one, so any shared span of at least K + WINDOW - 1 = 10 words shares a kept
fingerprint.  Training fingerprints are joined with the benchmark's, and each
hit is extended: the 10-word windows around it are looked up among the
benchmark's windows.  Items of fewer than 10 words are one window of their own
length and are looked up at every word of that length.

The benchmark's windows travel as a broadcast only while their counted size is
under ``BROADCAST_BYTES``; beyond it the fingerprints and then the windows are
joined by shuffles.

Words: maximal runs of a-z, 0-9 and non-ASCII characters after lower-casing
A-Z.  Null or empty texts have no words and hit nothing; items without words
never occur.  Repeated documents give a row each; repeated item rows count as
one item per id.  Empty tables are fine on either side.  Other columns are
ignored.

Windows and fingerprints are compared by 64-bit hashes; words are not compared
again, so a chance meeting of two hashes would count as a hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import RangeHash, keyed_text, pieces, sliding, stored, word_bounds

SPAN = 10      # fixed by the contract: words that make a window
K = 5          # words in a fingerprint
WINDOW = SPAN - K + 1
BROADCAST_BYTES = 64 << 20

_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
              for b in range(256))


def canonical(text: bytes | None) -> bytes:
    """The words of a text, lower-cased, joined by single spaces."""
    return b" ".join((text or b"").translate(_KEEP).split())


class Words:
    """Hashes of word windows of one text."""

    def __init__(self, text: bytes | None):
        joined = canonical(text)
        self.starts, self.ends = word_bounds(joined)
        self.n = len(self.starts)
        self._hash = RangeHash(joined)

    def windows(self, width: int) -> np.ndarray:
        if self.n < width:
            return np.zeros(0, np.uint64)
        return self._hash.of(self.starts[: self.n - width + 1], self.ends[width - 1:])

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the k-grams that are the minimum of a
        window: all of them where several tie, so the choice depends on the
        words alone."""
        grams = self.windows(K)
        least = sliding(grams, WINDOW)
        if not len(least):
            return np.zeros(0, np.int64), grams[:0]
        edge = np.zeros(WINDOW - 1, np.uint64)
        top = sliding(np.concatenate((edge, least, edge)), WINDOW, np.maximum)
        at = np.flatnonzero(grams == top[: len(grams)])
        return at, grams[at]


def _items(benchmark: DataFrame) -> DataFrame:
    """Benchmark windows: (item_id, words, window, fingerprint)."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.int32()), ("window", pa.int64()), ("mark", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, wins, marks = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = Words(text)
                width = min(words.n, SPAN)
                if not width:
                    continue
                win = words.windows(width)
                mark = sliding(words.windows(K), WINDOW) if width == SPAN else win
                ids += [item] * len(win)
                sizes += [width] * len(win)
                wins += win.view(np.int64).tolist()
                marks += mark.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, sizes, wins, marks), schema)],
                                             schema=schema)

    rows = keyed_text(benchmark, "item_id").select(F.col("doc_id").alias("item_id"), "text")
    return rows.mapInArrow(cut, "item_id long, words int, window long, mark long").distinct()


def _index(rows) -> tuple[dict, np.ndarray, dict]:
    """A benchmark of bounded size: items by (words, window), sorted
    fingerprints, and sorted windows by words for short items.  Plain types,
    since a broadcast is pickled by reference."""
    by_window: dict[tuple[int, int], set[int]] = {}
    marks: set[int] = set()
    short: dict[int, set[int]] = {}
    for item, words, window, mark in rows:
        by_window.setdefault((words, window), set()).add(item)
        (marks.add(mark) if words == SPAN else short.setdefault(words, set()).add(window))
    as_array = lambda s: np.sort(np.array(sorted(s), np.int64).view(np.uint64))
    return by_window, as_array(marks), {w: as_array(s) for w, s in short.items()}


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _around(positions: np.ndarray, n_windows: int) -> np.ndarray:
    """Starts of the SPAN-word windows that contain a k-gram at one of the positions."""
    starts = np.unique(positions[:, None] - np.arange(WINDOW)[None, :])
    return starts[(starts >= 0) & (starts < n_windows)]


def _result(doc, n_words: int, hits: list[tuple[int, int]], items: set[int]) -> tuple:
    """One output row from the (start, words) of the windows found."""
    covered = np.zeros(n_words + 1, np.int64)
    for start, width in hits:
        covered[start] += 1
        covered[start + width] -= 1
    n_hit = int((np.cumsum(covered) > 0).sum())
    ids = ",".join(sorted(map(str, items)))
    return doc, n_words, n_hit, len(items), hashlib.sha256(ids.encode()).hexdigest(), n_hit > 0


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                    ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _by_broadcast(docs: DataFrame, index: tuple[dict, np.ndarray, dict]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_window, known_marks, shorts = shared.value
        for batch in (p for b in batches for p in pieces(b, 1)):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = Words(text)
                hits, items = [], set()
                at, marks = words.fingerprints()
                at = at[_member(marks, known_marks)]
                found = [(s, SPAN, words.windows(SPAN)) for s in [_around(at, words.n - SPAN + 1)] if len(s)]
                for width, known in shorts.items():
                    win = words.windows(width)
                    found.append((np.flatnonzero(_member(win, known)), width, win))
                for starts, width, win in found:
                    for s in starts.tolist():
                        got = by_window.get((width, int(win[s].view(np.int64))))
                        if got:
                            hits.append((s, width))
                            items |= got
                out.append(_result(doc, words.n, hits, items))
            yield _rows(out, _ARROW)

    return docs.mapInArrow(scan, SCHEMA)


def _by_shuffle(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same without a broadcast: fingerprints are joined first, then the
    windows around the hits.  Rows are numbered, so that repeated ids stay apart."""
    docs = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate-docs")
    lengths = [r.words for r in windows.select("words").distinct().collect()]  # at most SPAN values

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("__row", pa.int64()), ("at", pa.int32()), ("mark", pa.int64())])
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                at, mark = Words(text).fingerprints()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array(at.astype(np.int32)),
                                                  pa.array(mark.view(np.int64))], schema=schema)

    known = windows.where(F.col("words") == SPAN).select("mark").distinct()
    places = (docs.select("__row", "text").mapInArrow(marks, "__row long, at int, mark long")
              .join(known, "mark").groupBy("__row").agg(F.collect_set("at").alias("at")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("__row", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("window", pa.int64())])
        for batch in batches:
            for row, text, at in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(),
                                     batch.column(2).to_pylist()):
                words = Words(text)
                for width in lengths:
                    win = words.windows(width)
                    starts = _around(np.array(at or [], np.int64), len(win)) if width == SPAN else np.arange(len(win))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(starts), row)), pa.array(starts.astype(np.int32)),
                         pa.array(np.full(len(starts), width, np.int32)), pa.array(win[starts].view(np.int64))],
                        schema=schema)

    found = (docs.join(places, "__row", "left").select("__row", "text", "at")
             .mapInArrow(probe, "__row long, start int, words int, window long")
             .join(windows.select("words", "window", "item_id"), ["words", "window"])
             .groupBy("__row").agg(F.collect_set(F.struct("start", "words")).alias("hits"),
                                   F.collect_set("item_id").alias("items")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, hits, items in zip(batch.column(0).to_pylist(),
                                              batch.column(1).cast(pa.binary()).to_pylist(),
                                              batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out.append(_result(doc, len(canonical(text).split()),
                                   [(h["start"], h["words"]) for h in hits or []], set(items or [])))
            yield _rows(out, _ARROW)

    return docs.join(found, "__row", "left").select("doc_id", "text", "hits", "items").mapInArrow(finish, SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    windows = stored(_items(benchmark), "benchmark-windows")
    docs = keyed_text(docs)
    # About 200 bytes of Python objects a window.
    if windows.count() * 200 <= broadcast_bytes:
        rows = ((r.item_id, r.words, r.window, r.mark) for r in windows.toLocalIterator())
        return _by_broadcast(docs, _index(rows))
    return _by_shuffle(docs, windows)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document has no hit, all columns kept.  Rows
    that share an id go together if one of them is hit."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    bad = stored(bad, "contaminated")  # usually few: the table's size decides the join
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")
