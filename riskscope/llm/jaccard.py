"""N-gram Jaccard join (operator 9): rare-first prefix filtering with length,
positional and suffix filters; each candidate pair is verified once.

1. A document's set is its distinct 5-word shingles, as 64-bit hashes.  A
   fixed table of ``BINS`` counters, filled from all documents, estimates how
   frequent a shingle is.  Sets are ordered by (estimate, hash): rare first.
   Any order common to all sets keeps the join complete; the estimate only
   keeps frequent shingles out of the prefixes.
2. Two sets at the threshold share a shingle in their prefixes.  Prefix
   shingles meet by a shuffle on the shingle; equal sets count once.
3. Groups around a prefix shingle are not expanded into all pairs.  First each
   member meets the group's smallest one; then, where groups still span several
   components, one drawn by hash.  Links found so far join components, and only
   members of different components can add anything.  The last round compares
   all such members, a bounded block with a block at a time, and passes on only
   those that the filters leave, so no link between components is missed,
   whatever the first rounds found.
4. Candidates must pass the length and positional filters (from the prefix
   entry) and the suffix filter (counts by hash range bound the difference of
   the two sets from below) before their texts are fetched and compared.

Links join documents, and a component's id is its smallest doc_id.  Documents
that share a set are one class (linked to each other); rows that share a
doc_id are one document.  Hashes of shingles and the 64-bit names of sets are
taken as equal only if the things are.

Nulls and texts without words have an empty set and are linked with nothing; a
null doc_id gets the smallest id of its component, which may be null.  Repeated
rows give a row each.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import RangeHash, keyed_text, mix, pieces, stored, word_bounds
from riskscope.llm.components import components

SHINGLE = 5
NUM, DEN = 75, 100      # the threshold, as a fraction
BINS = 1 << 18          # counters of the frequency table: a fixed 1 MB
SLICES = 64
RANGES = 256            # hash ranges of the suffix filter
STAR_ROUNDS = 2
BLOCK = 1024            # members of a group that are compared with as many at a time
BROADCAST_PAIRS = 1 << 20   # 16 MB of pairs


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of the lower-cased
    text; of the whole sequence if it is shorter."""
    joined = b" ".join((text or b"").lower().split())
    starts, ends = word_bounds(joined)
    if not len(starts):
        return np.zeros(0, np.uint64)
    width = min(size, len(starts))
    return np.unique(RangeHash(joined).of(starts[: len(starts) - width + 1], ends[width - 1:]))


def name_of(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    place = np.arange(1, len(items) + 1, dtype=np.uint64)
    one = mix(items * np.uint64(0xD6E8FEB86659FD93) + place)
    with np.errstate(over="ignore"):
        a = mix(np.array([one.sum(dtype=np.uint64) + np.uint64(len(items))], np.uint64))
        b = mix(np.array([mix(one ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _texts(batch: pa.RecordBatch, column: int = 1) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


_SET_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                         ("spread", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """One pass over the texts: a row (doc_id, n_shingles, s1, s2, spread) per
    document, where spread has the set's counts by hash range, a byte each, for
    the suffix filter; and, in rows with a slice, the task's counts of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in (p for b in batches for p in pieces(b, 1)):
            n, one, two, spread, bins = [], [], [], [], []
            for text in _texts(batch):
                items = shingles(text, size)
                a, b = name_of(items)
                n.append(len(items))
                one.append(a)
                two.append(b)
                counts = np.bincount((items >> np.uint64(56)).astype(np.int64), minlength=RANGES)
                spread.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
                bins.append((items & np.uint64(BINS - 1)).astype(np.int32))
            if bins:
                total += np.bincount(np.concatenate(bins), minlength=BINS)
            k = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()),
                                              pa.array(two, pa.int64()), pa.array(spread, pa.binary()), pa.nulls(k, pa.int32()),
                                              pa.nulls(k, pa.binary())], schema=_SET_SCHEMA)
        parts = {k: part.tobytes() for k, part in enumerate(np.split(total, SLICES)) if part.any()}
        empty = [pa.nulls(len(parts), f.type) for f in list(_SET_SCHEMA)[:5]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(list(parts), pa.int32()),
                                          pa.array(list(parts.values()), pa.binary())], schema=_SET_SCHEMA)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, spread binary, "
                                "slice int, counts binary")


def frequency_table(rows: DataFrame) -> np.ndarray:
    """The ``BINS`` counters over all tasks, from the rows of ``_sets``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(blob, np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         names=["slice", "counts"])

    parts = (rows.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice")
             .mapInArrow(add, "slice int, counts binary").collect())  # SLICES rows of BINS / SLICES counters
    total = np.zeros((SLICES, BINS // SLICES), np.int64)
    for r in parts:
        total[r.slice] = np.frombuffer(r.counts, np.int64)
    return total.ravel()


def _prefixes(docs: DataFrame, counts: np.ndarray, size: int) -> DataFrame:
    """(token, sp, s1): prefix shingles, each with size and position as one
    number.  Equal sets within a task are sent once."""
    known = docs.sparkSession.sparkContext.broadcast(counts.astype(np.float32))  # BINS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, sent = known.value, set()
        for batch in (p for b in batches for p in pieces(b, 0)):
            tokens, places, names = [], [], []
            for text in _texts(batch, 0):
                items = shingles(text, size)
                n = len(items)
                if not n or (name := name_of(items)) in sent:
                    continue
                sent.add(name)
                take = n - -(-NUM * n // DEN) + 1
                order = np.lexsort((items, rank[(items & np.uint64(BINS - 1)).astype(np.int64)]))[:take]
                tokens.append(items[order].view(np.int64))
                places.append((n << 32) + np.arange(take, dtype=np.int64))
                names.append(np.full(take, name[0], np.int64))
            cat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([cat(tokens), cat(places), cat(names)], names=["token", "sp", "s1"])

    return docs.select("text").mapInArrow(run, "token long, sp long, s1 long")


def _groups(prefixes: DataFrame) -> DataFrame:
    """(token, sp, s1, csp, c1): members of a prefix shingle's group, each with
    the group's smallest one.  Shingles in one prefix only are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # token, sp, s1 of the open group's first row; then sp, s1 of the last row
        for batch in batches:
            if not len(batch):
                continue
            token, sp, s1 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if last is not None:
                token, sp, s1 = (np.concatenate(([v], x)) for v, x in zip(last[:3], (token, sp, s1)))
            first = np.zeros(len(token), np.int64)
            new = np.flatnonzero(token[1:] != token[:-1]) + 1
            first[new] = new
            np.maximum.accumulate(first, out=first)
            keep = s1 != s1[first]
            keep[1:] &= (s1[1:] != s1[:-1]) | (token[1:] != token[:-1])
            f = first[-1]
            last = (token[f], sp[f], s1[f])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token[keep], sp[keep], s1[keep], sp[first][keep],
                                                                    s1[first][keep])],
                                             names=["token", "sp", "s1", "csp", "c1"])

    return (prefixes.repartition("token").sortWithinPartitions("token", "sp", "s1")
            .mapInArrow(run, "token long, sp long, s1 long, csp long, c1 long"))


def _possible(sp_a: str, sp_b: str):
    """Length and positional filter on two prefix entries of one shingle."""
    n = [F.shiftright(F.col(c), 32) for c in (sp_a, sp_b)]
    rest = [k - F.col(c).bitwiseAND(0xFFFFFFFF) for k, c in zip(n, (sp_a, sp_b))]
    return ((F.least(*n) * DEN >= F.greatest(*n) * NUM)
            & (F.least(*rest) * (DEN + NUM) >= (n[0] + n[1]) * NUM))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _all_pairs(open_groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) for members of different components in a group that pass the
    length, positional and suffix filters.  Groups are cut into blocks by hash;
    a task holds two blocks."""
    cuts = open_groups.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    own = open_groups.join(cuts, "token").withColumn("block", F.pmod(F.xxhash64("s1"), "k").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "s1", "sp", "comp")
    # The counts join last, so that one shuffle alone carries them.
    dealt = dealt.join(classes.select("s1", "spread"), "s1").select("token", "i", "j", "block", "s1", "sp", "comp", "spread")

    def pairs_of(t: pa.Table) -> pa.RecordBatch:
        """Rows of whole groups, in order: each row meets the one ``lag`` rows
        on for as long as that is in its group, all groups side by side."""
        keys = [t.column(c).to_numpy() for c in ("token", "i", "j")]
        s1, sp, comp, block = (t.column(c).to_numpy() for c in ("s1", "sp", "comp", "block"))
        spread = np.frombuffer(b"".join(t.column("spread").to_pylist()), np.uint8).reshape(-1, RANGES)
        n, rest = sp >> 32, (sp >> 32) - (sp & 0xFFFFFFFF)
        m = len(s1)
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        ends = np.append(np.flatnonzero(new) + 1, m)
        left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(m)  # rows to the end of the group
        across = keys[1] != keys[2]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        live, lag = np.arange(m), 1
        while len(live := live[left[live] > lag]):
            x, y = live, live + lag
            total, least = n[x] + n[y], np.minimum(n[x], n[y])
            ok = ((s1[x] != s1[y]) & (comp[x] != comp[y]) & (least * DEN >= (total - least) * NUM)
                  & (np.minimum(rest[x], rest[y]) * (DEN + NUM) >= total * NUM) & (~across[x] | (block[x] != block[y])))
            x, y = x[ok], y[ok]
            near = _near(spread[x], spread[y], n[x] + n[y])
            x, y = x[near], y[near]
            out.append((np.minimum(s1[x], s1[y]), np.maximum(s1[x], s1[y])))
            lag += 1
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in out)]))
                                           for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the group that may go on
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = [t.column(c).to_numpy() for c in ("token", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield pairs_of(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    return (dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
            .mapInArrow(run, "a long, b long").distinct())


def _near(x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Suffix filter: two sets differ in at least the sum of the differences of
    their counts by hash range."""
    apart = np.abs(x.astype(np.int16) - y).sum(axis=1, dtype=np.int64)
    return (total - apart) * (DEN + NUM) >= total * (2 * NUM)


def _suffix_filter(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Keep pairs whose counts by hash range do not rule out the threshold: the
    sets differ in at least the sum of the counts' differences."""
    side = lambda c: classes.select(F.col("s1").alias(c), F.col("n_shingles").alias(f"n_{c}"),
                                    F.col("spread").alias(f"spread_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, RANGES) for k in (4, 5))
            yield batch.select([0, 1]).filter(pa.array(_near(x, y, total)))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "spread_a", "spread_b")
    return both.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs, with ``linked``: the exact comparison of the two sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def items_of(name, text):
            if name in recent:
                recent.move_to_end(name)
            else:
                recent[name] = shingles(text, size)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[name]

        for batch in (p for b in batches for p in pieces(b, 2)):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for p, q, s, t in zip(a, b, _texts(batch, 2), _texts(batch, 3)):
                x, y = items_of(p, s), items_of(q, t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(DEN * common >= NUM * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                                             names=["a", "b", "linked"])

    side = lambda c: texts.select(F.col("s1").alias(c), F.col("text").alias(f"text_{c}"))
    first, second = side("b"), side("a")
    if pairs.count() <= BROADCAST_PAIRS:  # 16 bytes each: spare the texts a shuffle
        first = first.join(F.broadcast(pairs), "b")
        second = second.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi")
    else:
        first = first.join(pairs, "b")
    return first.join(second, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id per document."""
    docs = keyed_text(docs)
    scanned = stored(_sets(docs, size), "jaccard-sets")
    rows = scanned.where("slice is null").select("doc_id", "n_shingles", "s1", "s2", "spread")
    full = rows.where("n_shingles > 0")
    groups = stored(_groups(_prefixes(docs, frequency_table(scanned), size)), "jaccard-groups")
    named = groups.select("s1").union(groups.select(F.col("c1").alias("s1"))).distinct()
    classes = full.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("spread").alias("spread"))
    classes = stored(classes.join(named, "s1", "left_semi"), "jaccard-classes")

    # A doc_id may stand in several rows: with one text, which is then taken
    # once, or with several, which are then linked.
    ids = full.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("s1").alias("a"), F.max("s1").alias("hi"))
    ids = stored(ids.where("n > 1"), "jaccard-ids")
    links = stored(full.join(ids.where("doc_id is not null and a <> hi"), "doc_id").select(
        "a", F.col("s1").alias("b")).distinct(), "jaccard-links")
    wanted = classes.join(ids.select(F.col("doc_id").alias("__many")), F.col("rep").eqNullSafe(F.col("__many")), "left")
    wanted = wanted.select(F.col("rep").alias("__rep"), "s1", "s2",
                           F.coalesce(F.col("__many").isNotNull() | F.col("rep").isNull(), F.lit(False)).alias("many"))
    found = stored(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__rep"))).select("s1", "s2", "text", "many"),
                   "jaccard-texts")
    texts = found.where("not many").select("s1", "s2", "text").union(_own_text(found.where("many"), size))
    members = groups.select("token", "sp", "s1").union(
        groups.select("token", F.col("csp").alias("sp"), F.col("c1").alias("s1")).distinct())
    done, comps = None, None
    for step in range(STAR_ROUNDS + 1):
        if step == 0:
            met = groups.where(_possible("csp", "sp")).select(F.col("c1").alias("a"), F.col("s1").alias("b"))
            near = _suffix_filter(_pairs(met), classes)
        elif step < STAR_ROUNDS:
            open_groups = _open_groups(members, comps)
            drawn = open_groups.groupBy("token").agg(F.min_by(
                F.struct("s1", "sp", "comp"), F.xxhash64("token", "s1", F.lit(step))).alias("c"))
            met = open_groups.join(drawn, "token").where("comp <> c.comp").withColumn("csp", F.col("c.sp")).where(
                _possible("csp", "sp")).select(F.col("c.s1").alias("a"), F.col("s1").alias("b"))
            near = _suffix_filter(_pairs(met), classes)
        else:
            near = _all_pairs(_open_groups(members, comps), classes)
        if done is not None:
            near = near.join(done.select("a", "b"), ["a", "b"], "left_anti")
        checked = stored(_verified(stored(near, "jaccard-near"), texts, size), "jaccard-pairs")
        done = checked if done is None else done.union(checked)
        new = checked.where("linked").select("a", "b")
        comps = components((links if comps is None else comps.select("node", "root")).union(new).toDF("a", "b"))

    named_rows = full.join(comps.withColumnRenamed("node", "s1"), "s1", "left").select(
        "s1", "doc_id", F.coalesce("root", "s1").alias("comp"))
    least = named_rows.groupBy("s1", "comp").agg(F.min("doc_id").alias("low"))
    label = least.select("s1", "comp").join(least.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select(
        "s1", "component_id", F.lit(True).alias("__in"))
    return rows.join(label, (rows["s1"] == label["s1"]) & (rows["n_shingles"] > 0), "left").select(
        "doc_id", "n_shingles", F.when(F.col("__in"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _own_text(found: DataFrame, size: int) -> DataFrame:
    """Keep the texts that really have the set they were fetched for (a doc_id
    may stand in several rows), one a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, 2)):
            own = [name_of(shingles(t, size)) == (a, b) for a, b, t in
                   zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2))]
            yield batch.filter(pa.array(own, pa.bool_()))

    found = found.select("s1", "s2", "text")
    return found.mapInArrow(run, "s1 long, s2 long, text string").dropDuplicates(["s1", "s2"])


def _open_groups(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the groups that still span several components."""
    named = members.join(comps.withColumnRenamed("node", "s1"), "s1", "left").select(
        "token", "sp", "s1", F.coalesce("root", "s1").alias("comp"))
    several = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return stored(named.join(several.select("token"), "token", "left_semi"), "jaccard-open")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, once.  Rows
    without a doc_id cannot be told apart and stay.  All columns are kept."""
    found = near_duplicates(docs, size).where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("__stays"), F.count("*").alias("__n"))
    found = stored(found, "jaccard-found")
    # Ids to remove, usually few, as a table of their own: its size decides the join.
    removed = stored(found.where("not __stays or __n > 1").select("__id"), "jaccard-removed")
    once = docs.join(removed, docs["doc_id"] == removed["__id"], "left_anti")
    twice = stored(found.where("__stays and __n > 1").select("__id"), "jaccard-twice")
    if twice.isEmpty():
        return once
    more = docs.join(twice, docs["doc_id"] == twice["__id"], "left_semi")
    return once.unionByName(more.dropDuplicates(["doc_id"]))
