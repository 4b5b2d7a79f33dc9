"""Suffix-array dedup (operator 3): every byte that lies in a 50-byte string
which also starts in a document with a smaller doc_id is removed.

1. Anchors.  Of every 35 consecutive 16-byte strings the one with the smallest
   hash is an anchor, so every 50-byte window holds one, at the same place
   wherever the window occurs.  An anchor with the bytes around it that windows
   through it can reach is a segment.
2. Meeting.  (anchor, segment) hashes meet by anchor.  Where a segment occurs in
   several documents, all but the smallest lose it whole.  Two segments share a
   window only if they also agree over a core: the 39 or 40 bytes around the
   anchor that lie in all windows of one third of the places (windows that begin
   0-11, 12-23 or 24-34 bytes before the anchor).  Segments with a core that also
   stands in another segment, of another smallest document, are asked for by
   their smallest document, once each; nothing else can match.
3. Shards.  The bytes of those segments are gathered by anchor into shards of
   bounded size.  Each shard gets a suffix array (Larsson-Sadakane) and common
   prefixes (Kasai); a run of suffixes that agree over 50 bytes is one window,
   and it goes from all documents but its smallest.
4. Merging.  An anchor with too many segments for a shard is spread over
   several, whose sorted windows are then merged by binary search.
5. The answers return to the documents by the anchor's place, where windows
   become removed bytes.

Strings are judged on the input and never cross documents.  Answers are kept by
doc_id, place and segment; rows that share a doc_id are told apart by the
segment's hash.  A segment is known by 112 bits of hashes (64 of the whole, 48
of its anchor).

Nulls and empty texts have no bytes.  A null doc_id is smaller than all others;
rows with equal ids do not remove from each other.  Repeated rows give a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import RangeHash, keyed_text, mix, sliding, stored
from riskscope.llm.suffixes import WORD, common_prefixes, suffix_array, words_at

SPAN = 50                       # fixed by the contract
GRAM = 16
REACH = SPAN - GRAM             # bytes on either side that a window through an anchor can reach
CHUNK = 1 << 16                 # bytes of texts that are worked on at a time, in a processor's cache
BUCKET_BYTES = 8 << 20          # text whose anchors meet in one bucket
SEND_ENTRIES = 300_000          # entries that a task holds before it deals them out
SEND_SEGMENTS = 20_000          # segments that go from a task in one batch
SHARD_SEGMENTS = 4_000          # small enough for a processor's cache
MERGE_WINDOWS = 200_000
BATCH_BYTES = 8 << 20           # of rows that go to a Python worker at once
SAMPLE_DOCS = 4000              # documents that show which anchors are very common
COMMON = 0.02                   # share of them that makes an anchor so
CORES = ((16, 23), (-12, 11), (-24, -16))  # 16-byte strings, from the anchor, that make a core with it
CORE_BITS = 21                  # of a core's hash; zero where the text has no such core
ALWAYS = np.uint64(1 << 63)     # asked for, whatever the cores
FULL = (1 << 63) - 1            # all windows of a segment
_NULL = -(1 << 63)              # stands for a null doc_id
_ANCHOR_BITS = np.uint64((1 << 48) - 1)


def anchors(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(which text, anchor hash of 48 bits, segment hash, cores, anchor place), in
    lots of about CHUNK bytes: short texts side by side, long ones chunk by chunk.
    A place near a seam may come twice."""
    lot, held = [], 0
    for k, data in enumerate(texts):
        for chunk in range(0, len(data) - SPAN + 1, CHUNK):
            last = min(chunk + CHUNK, len(data) - SPAN + 1)  # window starts of this chunk end here
            lo = max(0, chunk - REACH)
            part = data[lo:last + 2 * SPAN]
            if lot and held + len(part) > CHUNK:
                yield _anchors(lot)
                lot, held = [], 0
            lot.append((part, k, lo, len(data), chunk - lo, last - lo))
            held += len(part)
    if lot:
        yield _anchors(lot)


def _anchors(lot: list[tuple]) -> tuple[np.ndarray, ...]:
    """Of parts of texts: bytes, which text, where in it, its size, and where
    windows start and stop to start in the part."""
    grams = _grams(b"".join(p[0] for p in lot))
    text, lo, size, start, stop = np.array([p[1:] for p in lot]).T
    base = np.cumsum([0, *(len(p[0]) for p in lot[:-1])])
    start, stop = start + base, stop + base
    least = sliding(grams, REACH + 1)
    own = np.zeros(len(grams) + REACH, np.uint64)  # zero where a window would reach over its part
    for a, b in zip(start.tolist(), stop.tolist()):
        own[REACH + a:REACH + b] = least[a:b]
    at = np.flatnonzero(grams == sliding(own, REACH + 1, np.maximum))
    k = np.searchsorted(base, at, "right") - 1
    inside = (at >= start[k]) & (at < stop[k] + REACH)
    if not inside.all():  # zero bytes across a seam
        at, k = at[inside], k[inside]
    zero = (base - lo)[k]  # where the text would begin
    begin, end = np.maximum(at - REACH, zero), np.minimum(at + SPAN, zero + size[k])
    return text[k], grams[at] & _ANCHOR_BITS, segment_hash(grams, at, begin, end), core_hashes(grams, at, begin, end), at - zero


def _grams(data: bytes) -> np.ndarray:
    """The hashes of the 16-byte strings."""
    words = words_at(np.frombuffer(data, np.uint8))
    n = max(len(data) - GRAM + 1, 0)
    return mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[GRAM - WORD:GRAM - WORD + n]))


def bounds(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the segments of anchors begin and end in a text of ``size`` bytes."""
    return np.maximum(at - REACH, 0), np.minimum(at + SPAN, size)


def segment_hash(grams: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of segments from those of the 16-byte strings that cover them, the
    anchor's place and the length."""
    h = ((at - begin) * 128 + (end - begin)).astype(np.uint64)
    for offset in range(0, REACH + SPAN, GRAM):
        h = mix((h + np.uint64(0x9E3779B97F4A7C15)) ^ grams[np.minimum(begin + offset, end - GRAM)])
    return h


_CORE_AT = np.array(CORES).T.reshape(-1, 1)
_CORE_SHIFT = np.arange(len(CORES), dtype=np.uint64)[:, None] * np.uint64(CORE_BITS)
_CORE = np.uint64((1 << CORE_BITS) - 1) << _CORE_SHIFT


def core_hashes(grams: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of an anchor's cores side by side in one number.  They are only
    compared among segments of one anchor, whose own 16 bytes are equal."""
    where = at + _CORE_AT
    room = (where >= begin) & (where <= end - GRAM)
    of = grams[np.where(room, where, 0)]
    n = len(CORES)
    h = (of[:n] * np.uint64(0x9E3779B97F4A7C15) + of[n:]) >> np.uint64(64 - CORE_BITS)
    return np.bitwise_or.reduce((np.maximum(h, np.uint64(1)) * (room[:n] & room[n:])) << _CORE_SHIFT, axis=0)


def core_keys(anchor: np.ndarray, cores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each core a row: its part of ``cores``, and its hash with the anchor's."""
    part = cores & _CORE
    return part, mix(anchor ^ mix(part + np.uint64(0x9E3779B97F4A7C15)))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id (nulls by their stand-in) and the text's bytes."""
    return docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"),
                       F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))


def _common_anchors(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors, and anchors with a core, of a large share of a bounded sample of
    documents.  They are only dealt out differently, so the sample does not touch
    the result."""
    fraction = min(1.0, SAMPLE_DOCS / max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, anchor, _, cores, _ in anchors(t.as_py() for t in batch.column(0)):
                part, keys = core_keys(anchor, cores)
                for core, k, values in ((False, text, anchor), *((True, text[p != 0], key[p != 0]) for p, key in zip(part, keys))):
                    order = np.lexsort((k, values))
                    k, values = k[order], values[order]
                    new = np.append(True, (values[1:] != values[:-1]) | (k[1:] != k[:-1]))[:len(k)]  # once a document
                    first = np.flatnonzero(np.append(True, values[new][1:] != values[new][:-1])[:new.sum()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values[new][first].view(np.int64)), pa.array(np.full(len(first), core)),
                         pa.array(np.diff(np.append(first, new.sum())))], names=["hash", "core", "n"])

    counts = (rows.select("text").sample(fraction, 17).mapInArrow(run, "hash long, core boolean, n long")
              .groupBy("hash", "core").agg(F.sum("n").alias("n")))
    least = max(20, int(COMMON * fraction * n))
    # At most 4 x (anchors of the sample) / least rows.
    found = counts.where(F.col("n") >= least).collect()
    known, cores = (np.sort(np.array([r.hash for r in found if r.core == kind], np.int64).view(np.uint64)) for kind in (False, True))
    return known, cores


def _meet(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(doc_id, at, anchor, seg, whole): ``whole`` says that the segment goes
    from the document; otherwise it is to be asked for, and may come up to three
    times.

    Entries go to a bucket by their anchor.  Those of a common anchor go by their
    segment, without cores, and once more for each core by anchor and core.  A
    core that is common as well is not counted: its segments are all asked for."""
    entry = np.dtype([("seg", "<u8"), ("low", "<u4"), ("high", "<u2"), ("doc", "<i8"), ("at", "<u4"), ("cores", "<u8")])
    anchor_of = lambda e: e["low"].astype(np.uint64) | (e["high"].astype(np.uint64) << np.uint64(32))
    spread = rows.sparkSession.sparkContext.broadcast(common)  # bounded by the sample
    out = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("anchor", pa.int64()), ("seg", pa.int64()),
                     ("whole", pa.bool_())])

    def in_order(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries by (seg, anchor), their anchors, and where each segment begins."""
        e = e.take(np.argsort(e["seg"]))
        anchor = anchor_of(e)
        new = np.concatenate((np.ones(min(len(e), 1), bool), e["seg"][1:] != e["seg"][:-1]))
        mixed = np.flatnonzero(~new)
        if len(mixed) and (anchor[mixed] != anchor[mixed - 1]).any():  # hashes of unlike segments agree
            order = np.lexsort((anchor, e["seg"]))
            e, anchor = e.take(order), anchor[order]
        new[1:] = (e["seg"][1:] != e["seg"][:-1]) | (anchor[1:] != anchor[:-1])
        return e, anchor, new

    def rows_of(e: np.ndarray, anchor: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        cols = [e["doc"], e["at"].astype(np.int64), anchor.astype(np.int64), e["seg"].view(np.int64)]
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in cols), pa.array(whole)], schema=out)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])
        parts, held = [], 0
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for text, anchor, seg, cores, at in anchors(t.as_py() for t in batch.column(1)):
                e = np.empty(len(at), entry)
                e["low"], e["high"] = anchor & np.uint64(0xFFFFFFFF), anchor >> np.uint64(32)
                e["seg"], e["doc"], e["at"], e["cores"] = seg, docs[text], at, cores
                parts.append(e)
                held += len(e)
                if held >= SEND_ENTRIES:
                    yield pa.RecordBatch.from_arrays(by_bucket(np.concatenate(parts)), schema=schema)
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays(by_bucket(np.concatenate(parts)), schema=schema)

    def by_bucket(e: np.ndarray) -> list[pa.Array]:
        (known, common_cores), where = spread.value, anchor_of(e)
        hot = _among(where, known)
        if hot.any():
            of, anchor, e, where = e[hot], where[hot], e.take(np.flatnonzero(~hot)), where[~hot]
            part, key = core_keys(anchor, of["cores"])
            often = _among(key, common_cores) & (part != 0)
            always = often.any(axis=0)
            counted = (part != 0) & ~often
            lots = [of.copy(), *(of[k] for k in counted)]
            lots[0]["cores"] = np.where(always, ALWAYS, np.uint64(0))
            for lot, p, k in zip(lots[1:], part, counted):
                lot["cores"] = p[k]
            e = np.concatenate((e, *lots))
            where = np.concatenate((where, anchor ^ mix(of["seg"]), *(x[k] for x, k in zip(key, counted))))
        bucket = (mix(where) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")  # by radix where it fits
        e, bucket = e.take(order), bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        return [pa.array(bucket[cuts[:-1]]), pa.array([e[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and held:
                    yield decide(np.concatenate(held))
                    held = []
                now = bucket
                held.append(np.frombuffer(blob.as_py(), entry))
        if held:
            yield decide(np.concatenate(held))

    def decide(e: np.ndarray) -> pa.RecordBatch:
        e, anchor, new = in_order(e)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(e)))
        low = np.minimum.reduceat(e["doc"], starts)
        cores = np.bitwise_or.reduceat(e["cores"], starts)
        asked = cores >= ALWAYS
        for part, key in zip(*core_keys(anchor[starts], cores)):
            own = np.flatnonzero(part)
            own = own[np.argsort(key[own])]
            key, doc = key[own], low[own]
            # Cores in segments of one smallest document only take nothing from anyone.
            first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
            if len(first):
                apart = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
                asked[own[np.repeat(apart, np.diff(np.append(first, len(own))))]] = True
        whole = e["doc"] > np.repeat(low, sizes)
        # An entry that only counts a core leaves the copies to the one that went by its segment.
        counts = _among(anchor, spread.value[0]) & ((e["cores"] & ~ALWAYS) != 0)
        keep = np.flatnonzero(np.where(whole, ~counts, np.repeat(asked, sizes)))
        return rows_of(e.take(keep), anchor[keep], whole[keep])

    dealt = rows.mapInArrow(deal, "bucket int, entries binary")
    return (dealt.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(gather, "doc_id long, at long, anchor long, seg long, whole boolean"))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _is_at(data: bytes, at: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Which of the segments stand at their places in this text: a doc_id may
    stand in several rows."""
    begin, end = bounds(at, len(data))
    inside = np.flatnonzero(end - begin >= SPAN)
    out = np.zeros(len(at), bool)
    out[inside] = segment_hash(_grams(data), at[inside], begin[inside], end[inside]) == seg[inside]
    return out


def _segments(rows: DataFrame, asked: DataFrame, several: bool) -> DataFrame:
    """The bytes of the segments that are asked for."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()),
                        ("bytes", pa.binary())])
    wanted = asked.groupBy("doc_id").agg(F.collect_list(F.struct("at", "anchor", "seg")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, held, size = ([], [], [], []), [], 0
            for doc, text, of in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = text.as_py()
                at, anchor, seg = (of.values.field(c).to_numpy() for c in ("at", "anchor", "seg"))
                order = np.lexsort((seg, at))
                at, anchor, seg = at[order], anchor[order], seg[order]
                once = np.append(True, (at[1:] != at[:-1]) | (seg[1:] != seg[:-1]))  # else asked for by several cores
                if several:
                    once &= _is_at(data, at, seg.view(np.uint64))
                if not once.all():
                    at, anchor, seg = at[once], anchor[once], seg[once]
                begin, end = bounds(at, len(data))
                held += [data[a:b] for a, b in zip(begin.tolist(), end.tolist())]
                for col, values in zip(cols, (anchor, seg, np.full(len(at), doc), at)):
                    col.append(values)
                size += len(at)
                if size >= SEND_SEGMENTS:
                    yield packed(cols, held)
                    cols, held, size = ([], [], [], []), [], 0
            if held:
                yield packed(cols, held)

    def packed(cols: tuple[list, ...], held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in cols), pa.array(held, pa.binary())], schema=schema)

    return rows.join(wanted, "doc_id").select("doc_id", "text", "of").mapInArrow(
        run, "anchor long, seg long, doc_id long, at long, bytes binary")


ANSWER = "doc_id long, at long, seg long, windows long"
_ANSWER = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("seg", pa.int64()), ("windows", pa.int64())])
_SHARD = pa.schema([*_ANSWER, ("anchor", pa.int64()), ("piece", pa.int32()), ("run", pa.binary())])
_RUN = np.dtype([("window", f"S{SPAN}"), ("doc", "<i8"), ("at", "<i8"), ("seg", "<i8"), ("j", "<i4")])


def search_shard(table: pa.Table) -> pa.Table:
    """One shard: for each segment, the windows that start in a smaller document
    too, as bits; for anchors spread over shards (``parts`` of them, else 0), also
    the sorted windows."""
    docs, parts = table.column("doc_id").to_numpy(), table.column("parts").to_numpy()
    wide = parts > 0
    blobs = table.column("bytes").to_pylist()
    if not wide.any():  # a segment that stands in a document several times is searched once
        name = table.column("seg").to_numpy().view(np.uint64) ^ mix(table.column("anchor").to_numpy().view(np.uint64))
        _, first, places = np.unique(name, return_index=True, return_inverse=True)
        docs, wide, parts, blobs = docs[first], wide[first], parts[first], [blobs[k] for k in first]
    else:
        places = np.arange(len(blobs))
    sizes = np.array([len(b) for b in blobs], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    # The separator is no byte of UTF-8; windows never reach over one anyway.
    data = np.frombuffer(b"\xff".join(blobs) + b"\xff", np.uint8)
    order = suffix_array(data, SPAN)
    agree = common_prefixes(data, order, SPAN)
    owner = np.repeat(np.arange(len(blobs)), sizes + 1)[order]
    offset = order - begin[owner]
    valid = offset + SPAN <= sizes[owner]
    # Suffixes between two valid ones with equal windows share them as well.
    window = np.cumsum(agree < SPAN)[valid]
    order, owner, offset = order[valid], owner[valid], offset[valid]
    doc = docs[owner]
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(window), 1), bool), window[1:] != window[:-1])))
    low = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(doc)))) if len(doc) else doc
    gone = doc > low
    bits = np.zeros(len(blobs), np.int64)
    np.bitwise_or.at(bits, owner[gone], np.int64(1) << offset[gone])
    bits_at = bits[places]
    found = np.flatnonzero(bits_at)
    take = lambda name, k: table.column(name).take(pa.array(k)).combine_chunks()
    none = lambda kind, k: pa.nulls(k, kind)
    results = [[take("doc_id", found), take("at", found), take("seg", found), pa.array(bits_at[found]),
                none(pa.int64(), len(found)), none(pa.int32(), len(found)), none(pa.binary(), len(found))]]
    least = np.flatnonzero(wide[owner] & ~gone)
    if len(least):
        run = np.empty(len(least), _RUN)
        run["window"] = np.lib.stride_tricks.sliding_window_view(data, SPAN)[order[least]].copy().view(f"S{SPAN}")[:, 0]
        own = owner[least]
        run["doc"], run["at"], run["seg"] = docs[own], table.column("at").to_numpy()[own], table.column("seg").to_numpy()[own]
        run["j"] = offset[least]
        anchor = table.column("anchor").to_numpy()[own]
        # As many pieces as the anchor's own windows fill: pieces times shards are rows.
        pieces = (-(-parts[own] * SHARD_SEGMENTS * (REACH + 1) // MERGE_WINDOWS)).astype(np.uint64)
        place = (RangeHash(data.tobytes()).of(order[least], order[least] + SPAN) % pieces).astype(np.int32)
        split = np.lexsort((np.arange(len(least)), place, anchor))  # windows stay sorted in each part
        cuts = np.flatnonzero(np.concatenate(([True], (np.diff(anchor[split]) != 0) | (np.diff(place[split]) != 0), [True])))
        heads = split[cuts[:-1]]
        k = len(heads)
        results.append([none(pa.int64(), k)] * 4 + [pa.array(anchor[heads]), pa.array(place[heads]),
                                                    pa.array([run[split[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())])
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(r, schema=_SHARD) for r in results])


def merge_runs(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For sorted runs of windows, the smallest document over all runs for every
    entry, by binary search of each run in the windows merged so far."""
    windows, low = np.zeros(0, f"S{SPAN}"), np.zeros(0, np.int64)
    for run in runs:
        own, first = np.unique(run["window"], return_index=True)
        least = np.minimum.reduceat(run["doc"], first)
        at = np.searchsorted(windows, own)
        known = at < len(windows)
        known[known] = windows[at[known]] == own[known]
        low[at[known]] = np.minimum(low[at[known]], least[known])
        windows = np.insert(windows, at[~known], own[~known])
        low = np.insert(low, at[~known], least[~known])
    return [low[np.searchsorted(windows, run["window"])] for run in runs]


def _merge_group(table: pa.Table) -> pa.Table:
    runs = [np.frombuffer(b, _RUN) for b in table.column("run").to_pylist()]
    out = []
    for run, low in zip(runs, merge_runs(runs)):
        gone = run[run["doc"] > low]
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(gone[c])) for c in ("doc", "at", "seg")]
            + [pa.array(np.int64(1) << gone["j"].astype(np.int64))], schema=_ANSWER))
    return pa.Table.from_batches(out, schema=_ANSWER)


def _search(segments: DataFrame) -> DataFrame:
    """Answers for the segments, by shards and, for wide anchors, by merging."""
    wide = stored(segments.groupBy("anchor").count().where(F.col("count") > SHARD_SEGMENTS)
                  .select("anchor", F.ceil(F.col("count") / SHARD_SEGMENTS).cast("long").alias("parts")), "repeats-wide")
    total = segments.count()
    shards = max(1, -(-total // SHARD_SEGMENTS))
    salted = F.xxhash64("anchor", F.pmod("seg", "parts"))
    keyed = segments.join(wide, "anchor", "left").select(
        "anchor", "seg", "doc_id", "at", "bytes", F.coalesce("parts", F.lit(0)).alias("parts"), F.col("parts").isNotNull().alias("wide"),
        F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(salted).alias("shard"))
    fields = [f"{f.name} {'binary' if f.type == pa.binary() else 'int' if f.type == pa.int32() else 'long'}" for f in _SHARD]
    found = stored(keyed.groupBy("shard", "wide").applyInArrow(search_shard, ", ".join(fields)),
                   "repeats-shards")
    merged = found.where("run is not null").groupBy("anchor", "piece").applyInArrow(_merge_group, ANSWER)
    return found.where("run is null").select("doc_id", "at", "seg", "windows").unionByName(merged)


def _apply(data: bytes, at: np.ndarray, windows: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, removed runs, and the digest of the rest."""
    edge = np.zeros(len(data) + 1, np.int64)
    begin, end = bounds(at, len(data))
    whole = windows == FULL
    np.add.at(edge, begin[whole], 1)
    np.add.at(edge, end[whole], -1)
    begin = begin[~whole]
    row, j = np.nonzero((windows[~whole][:, None] >> np.arange(REACH + 1)) & 1)
    np.add.at(edge, begin[row] + j, 1)
    np.add.at(edge, begin[row] + j + SPAN, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(rows: DataFrame, answers: DataFrame, several: bool) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    of = answers.groupBy("doc_id").agg(F.collect_list(F.struct("at", "seg", "windows")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids = [None if d == _NULL else d for d in batch.column(0).to_pylist()]
            for text, of in zip(batch.column(1), batch.column(2)):
                data, got = text.as_py(), None
                if of.is_valid:
                    at, seg, windows = (of.values.field(c).to_numpy() for c in ("at", "seg", "windows"))
                    own = _is_at(data, at, seg.view(np.uint64)) if several else slice(None)
                    if len(at[own]):
                        got = _apply(data, at[own], windows[own])
                got = got or (0, 0, hashlib.sha256(data).hexdigest())
                for column, v in zip(out, (len(data), *got)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *out], schema)], schema=schema)

    return rows.join(of, "doc_id", "left").select("doc_id", "text", "of").mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document."""
    rows = _rows(keyed_text(docs))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    twice = stored(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeats-twice")
    several = not twice.isEmpty()
    once = rows
    if several:  # a row that stands twice is asked once; only rows whose doc_id repeats are shuffled for it
        once = rows.join(twice, "doc_id", "left_anti").unionByName(
            rows.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    common = _common_anchors(rows, n)
    met = stored(_meet(once, common, max(8, -(-size // BUCKET_BYTES))), "repeats-met", BATCH_BYTES)
    asked = met.where("not whole").select("doc_id", "at", "anchor", "seg")
    segments = stored(_segments(once, asked, several), "repeats-segments", BATCH_BYTES)
    whole = met.where("whole").select("doc_id", "at", "seg", F.lit(FULL).alias("windows"))
    return _finish(rows, whole.unionByName(_search(segments)), several)
