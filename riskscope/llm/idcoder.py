"""Token-id output (operator 7): an adaptive context-mixing range coder.

Ids are cut into blocks of ``BLOCK`` that are coded on their own: each starts
with fresh models and carries a checksum.  For every id the order-2 and order-1
contexts name the id that last followed them; a small mixer weighs how far each
has been right, and how often any was, into the probability that the named id
comes, which drives a range coder.  Other ids are coded by the order-0 model:
64 slots whose counts adapt within the block (new counts hold every 32 ids), then
the id within its slot.  A block's counts start from how often ids occur in the
segment, which its header tells; the most frequent ids have a slot each, the
others are dealt over the rest, where their shares add up to a power of two.  All
model arithmetic is in whole numbers, so any machine decodes the same.  Ids are
any unsigned 32-bit integers.

Blocks are coded side by side: numpy takes one step in every block at once.

File format: a segment holds whole documents.
    b"IDS3", u32 block length, u64 documents, u64 ids, u64 blocks, u32 distinct
    ids, u32 bytes and u32 crc32 of the id table,
    i64 doc_id[documents], u8 has_id[documents], u64 ids[documents],
    the id table: zlib of u32 steps between the ascending ids, u32 frequencies,
    per block: u32 ids, u32 words, u32 crc32 of the block's words,
    the blocks' u32 words; all little-endian.
Segments are rows of a Parquet table, in document order by (part, seq).

Nulls and empty texts give the end id alone.  A null doc_id sorts first;
repeated ids lie next to each other in any order.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskscope.llm.common import keyed_text, pieces, stored

BLOCK = 1024
LANES = 4096             # blocks coded side by side
SEGMENT_IDS = BLOCK * LANES
_LOT_BYTES = 2 << 20     # of texts split at once
END_ID = 2               # fixed by the contract

_CONTEXTS = 256          # contexts remembered per order and block
_SLOTS, _ALONE = 64, 32  # slots of order 0, and those of a single id
_SEED, _GAIN = 4096, 16  # order-0 counts at the start of a block; what an id adds to its slot
_EVERY = 32              # ids of a block after which new order-0 counts hold
_HEAVY = 1 << 17         # weights of the mixer are cut to this by then, so that 32 bits hold its sums
_DENSE = 1 << 22         # ids below this are counted in one array
_MOST = 1 << 22          # frequencies of a segment add up to about this at most
_K = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(56)   # leaves the bits of a context's number


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """squash: logit (in 1/256) to 12-bit probability; stretch: its inverse."""
    squash = np.array([int(4096 * 2.0 ** 40 / (2.0 ** 40 + round(2.0 ** 40 * 2.718281828459045 ** (-x / 256))))
                       for x in range(-2047, 2048)], np.int64).clip(1, 4095)
    stretch = (np.searchsorted(squash, np.arange(4096)) - 2047).clip(-2047, 2047)
    return squash.astype(np.int32), stretch.astype(np.int32)


_SQUASH, _STRETCH = _tables()


class _Ids:
    """The ids of a segment as symbols 0, 1, ...: by slot of the order-0 model, a
    slot's most frequent first.  ``ids`` ascend; frequencies are at least 1."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        n = len(ids)
        place = np.empty(n, np.int64)
        place[np.lexsort((ids, -freq))] = np.arange(n)
        slot = np.where(place < _ALONE, place, _ALONE + (place - _ALONE) % (_SLOTS - _ALONE))
        order = np.lexsort((place, slot))
        self.symbol = np.empty(n, np.uint32)  # of each of ``ids``
        self.symbol[order] = np.arange(n)
        self.ids, self.slot = ids[order].astype(np.int64), slot[order]
        members = np.bincount(slot, minlength=_SLOTS)
        first, total = np.cumsum(members) - members, np.bincount(slot, freq, _SLOTS).astype(np.int64)
        # In its slot an id has a share of 1 << bits, of at least one.
        self.bits = max(14, int(members.max()).bit_length() + 2)
        rank, room = np.arange(n) - first[self.slot], (1 << self.bits) - members[self.slot]
        freq = freq[order].astype(np.int64)
        ahead = np.cumsum(freq) - freq - (np.cumsum(total) - total)[self.slot]
        bound = lambda sums, rank: sums * room // total[self.slot] + rank
        self.inner = bound(ahead, rank).astype(np.uint64)
        self.share = (bound(ahead + freq, rank + 1)).astype(np.uint64) - self.inner
        # A block's first counts; a slot without ids has none.
        self.seed = np.where(total > 0, np.maximum(1, total * _SEED // max(1, int(total.sum()))), 0)

    @cached_property
    def at(self) -> np.ndarray:
        """The symbol whose share covers each place, slot by slot."""
        return np.repeat(np.arange(len(self.share), dtype=np.uint32), self.share.astype(np.int64))


def _pick(mask: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """np.where for unsigned integers, without a branch an element."""
    return no ^ ((yes ^ no) & np.negative(mask.astype(yes.dtype)))


class _Models:
    """The adaptive state of ``n`` blocks; every method works on the first
    ``m`` of them, those that still have ids."""

    def __init__(self, n: int, ids: _Ids):
        rows = np.arange(n, dtype=np.int64)
        self.place = np.stack((rows, rows + n)).astype(np.uint64) * np.uint64(_CONTEXTS)
        self.follow = np.zeros(2 * n * _CONTEXTS, np.uint32)       # symbol << 3 | times right
        self.cell = np.stack((rows * 32, rows * 32 + 16))
        self.chance = np.full(n * 32, 1 << 15, np.uint16)
        self.any = np.full(n, 1 << 15, np.int32)
        self.weight = np.full((3, n), 1 << 15, np.int32)
        self.one, self.two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.counts = np.tile(np.append(ids.seed, 0).astype(np.uint16), (n, 1))
        self.sums = np.zeros((n, _SLOTS + 1), np.uint16)
        self.all = np.zeros(n, np.uint64)
        self.recent = np.full((_EVERY, n), _SLOTS, np.int64)       # slots of other ids, else _SLOTS
        self.lines = rows * (_SLOTS + 1)

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The id named for every block, and its 12-bit probability."""
        at = np.empty((2, m), np.uint64)
        np.multiply(self.one[:m], _K, out=at[1])
        np.add(at[1], self.two[:m], out=at[0])
        at[0] *= _K
        at >>= _SHIFT
        at += self.place[:, :m]
        self.at = at.view(np.int64)
        self.seen = self.follow.take(self.at, mode="clip")
        self.ids, self.times = self.seen >> np.uint32(3), self.seen & np.uint32(7)
        named = self.ids[0] + self.ids[1] * (self.times[0] == 0)   # a context not met names symbol 0
        state = self.times.astype(np.int64)
        state[1] <<= 1
        state[1] += self.ids[1] == named
        state += self.cell[:, :m]
        self.state, chance = state, self.chance.take(state, mode="clip")
        self.old = chance.astype(np.int32)
        self.x = x = np.empty((3, m), np.int32)
        _STRETCH.take((chance >> np.uint16(4)).astype(np.int64), out=x[:2], mode="clip")
        _STRETCH.take((self.any[:m] >> 4).astype(np.int64), out=x[2], mode="clip")
        dot = self.weight[0, :m] * x[0]
        dot += self.weight[1, :m] * x[1]
        dot += self.weight[2, :m] * x[2]
        dot >>= 16
        dot += 2047
        self.p = _SQUASH.take(dot.astype(np.int64), mode="clip")
        return named, self.p

    def update(self, m: int, hit: np.ndarray, new: np.ndarray) -> None:
        """Learn whether the named id came, and the id that came."""
        came = hit.astype(np.int32)
        error = came << 12
        error -= self.p
        error *= 6
        step = self.x * error
        step >>= 14
        self.weight[:, :m] += step
        goal = came * 65535
        change = goal - self.old
        change >>= 4
        change += self.old
        self.chance[self.state] = change.astype(np.uint16)
        self.any[:m] += (goal - self.any[:m]) >> 4
        seen, times = self.seen, self.times
        other = _pick(times > 1, seen - (times >> np.uint32(1)), (new << np.uint32(3)) | np.uint32(1))
        self.follow[self.at] = _pick(self.ids == new, seen + (times < 7), other)
        self.two[:m] = self.one[:m]
        np.add(new, 1, out=self.one[:m], dtype=np.uint64)

    def total_up(self, m: int) -> None:
        """Order 0: the counts so far become the distribution."""
        line = self.recent[:, :m].T + self.lines[:m, None]
        new = np.bincount(line.ravel(), minlength=m * (_SLOTS + 1)).reshape(m, _SLOTS + 1).astype(np.uint16)
        self.recent.fill(_SLOTS)
        self.counts[:m, :_SLOTS] += new[:, :_SLOTS] * np.uint16(_GAIN)
        np.cumsum(self.counts[:m, :_SLOTS], 1, np.uint16, out=self.sums[:m, 1:])
        self.all[:m] = self.sums[:m, _SLOTS]
        np.clip(self.weight, -_HEAVY, _HEAVY, out=self.weight)

    def interval(self, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order 0: where the slot's count lies among the block's counts."""
        line = self.lines.take(at, mode="clip")
        line += slot
        low = self.sums.take(line, mode="clip")
        line += 1
        return low.astype(np.uint64), (self.sums.take(line, mode="clip") - low).astype(np.uint64)

    def slot(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Order 0: the slot whose count covers the place."""
        first, place = self.lines.take(at, mode="clip"), place.astype(np.uint16)
        line, half = first.copy(), _SLOTS >> 1
        while half:
            line += (self.sums.take(line + half, mode="clip") <= place) * half
            half >>= 1
        line -= first
        return line


_JOINT = 17  # bits of a share that a range has left after a slot of 15 bits
_HALF, _FULL = np.uint64(32), np.uint64(1 << 32)
_BITS = np.uint64(12)


class _Writer:
    """Range coder of ``n`` blocks: 64-bit low and range, words of 32 bits.  A
    carry is added to the word before; words are put in order at the end."""

    def __init__(self, n: int, room: int):
        self.low = np.zeros(n, np.uint64)
        self.range = np.full(n, (1 << 64) - 1, np.uint64)
        self.words = np.zeros((n, room), np.uint64)
        self.next = np.arange(n) * room
        self.first = self.next.copy()

    def bit(self, m: int, p: np.ndarray, hit: np.ndarray) -> None:
        low, rng = self.low[:m], self.range[:m]
        part = (rng >> _BITS) * p.astype(np.uint64)
        after = low + part * ~hit
        self.carry(after < low, slice(0, m))
        low[:] = after
        rng[:] = _pick(hit, part, rng - part)
        small = np.flatnonzero(rng < _FULL)
        if len(small):
            self.shift(small, low[small], rng[small])

    def narrow(self, at: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray,
               inner: np.ndarray, share: np.ndarray, bits: int) -> None:
        """To the slot, and in it to the id's share."""
        low, step = self.low.take(at, mode="clip"), self.range.take(at, mode="clip") // total
        add, rng = step * start, step * size
        if bits > _JOINT:
            self.put(at, low, low + add, rng)
            low, add, rng = self.low.take(at), np.uint64(0), self.range.take(at)
        step = rng >> np.uint64(bits)
        add = add + step * inner
        self.put(at, low, low + add, step * share)

    def put(self, at: np.ndarray, before: np.ndarray, low: np.ndarray, rng: np.ndarray) -> None:
        self.carry(low < before, at)
        self.low[at], self.range[at] = low, rng
        small = np.flatnonzero(rng < _FULL)
        if len(small):
            self.shift(at[small], low[small], rng[small])

    def carry(self, over: np.ndarray, at) -> None:
        if over.any():
            self.words.ravel()[self.next[at][over] - 1] += np.uint64(1)

    def shift(self, at: np.ndarray, low: np.ndarray, rng: np.ndarray) -> None:
        place = self.next.take(at)
        self.words.ravel()[place] = low >> _HALF
        self.next[at] = place + 1
        self.low[at], self.range[at] = low << _HALF, rng << _HALF

    def finish(self) -> list[np.ndarray]:
        for _ in range(2):
            self.shift(np.arange(len(self.low)), self.low, self.range)
        size = self.next - self.first
        words = self.words[:, :size.max(initial=0)]
        over = words >> _HALF
        while over.any():
            words &= _FULL - np.uint64(1)
            words[:, :-1] += over[:, 1:]
            over = words >> _HALF
        return [w[:s].astype(np.uint32) for w, s in zip(words, size)]


class _Reader:
    """The other way: ``code`` is where the block's number lies in the range."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.words, self.next = words, first + 2
        self.code = (words[first].astype(np.uint64) << _HALF) | words[first + 1]
        self.range = np.full(len(first), (1 << 64) - 1, np.uint64)

    def bit(self, m: int, p: np.ndarray) -> np.ndarray:
        code, rng = self.code[:m], self.range[:m]
        part = (rng >> _BITS) * p.astype(np.uint64)
        hit = code < part
        code -= part * ~hit
        rng[:] = _pick(hit, part, rng - part)
        small = np.flatnonzero(rng < _FULL)
        if len(small):
            self.shift(small, code[small], rng[small])
        return hit

    def peek(self, at: np.ndarray, total: np.ndarray) -> np.ndarray:
        self.now = self.code.take(at, mode="clip")
        self.step = self.range.take(at, mode="clip") // total
        return np.minimum(self.now // self.step, total - np.uint64(1))

    def enter(self, at: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
        """Into the slot after ``peek``; the place in it."""
        code, rng = self.now - self.step * start, self.step * size
        if bits > _JOINT:
            self.put(at, code, rng)
            code, rng = self.code.take(at), self.range.take(at)
        self.now, self.step = code, rng >> np.uint64(bits)
        return np.minimum(code // self.step, np.uint64((1 << bits) - 1)).view(np.int64)

    def settle(self, at: np.ndarray, inner: np.ndarray, share: np.ndarray) -> None:
        self.put(at, self.now - self.step * inner, self.step * share)

    def put(self, at: np.ndarray, code: np.ndarray, rng: np.ndarray) -> None:
        self.code[at], self.range[at] = code, rng
        small = np.flatnonzero(rng < _FULL)
        if len(small):
            self.shift(at[small], code[small], rng[small])

    def shift(self, at: np.ndarray, code: np.ndarray, rng: np.ndarray) -> None:
        place = self.next.take(at)
        self.code[at] = (code << _HALF) | self.words.take(place)
        self.range[at] = rng << _HALF
        self.next[at] = place + 1


def _live(sizes: np.ndarray) -> list[int]:
    """How many blocks have an id at each place."""
    return np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left").tolist()


def encode_blocks(symbols: np.ndarray, sizes: np.ndarray, ids: _Ids) -> list[np.ndarray]:
    """Words of each block; ``symbols`` is (BLOCK, blocks), sizes do not increase."""
    n = symbols.shape[1]
    models, out = _Models(n, ids), _Writer(n, 2 * BLOCK + 16)
    for t, m in enumerate(_live(sizes)):
        if t % _EVERY == 0:
            models.total_up(m)
        now = symbols[t, :m]
        named, p = models.predict(m)
        hit = named == now
        out.bit(m, p, hit)
        miss = np.flatnonzero(~hit)
        if len(miss):
            symbol = now[miss]
            slot = ids.slot.take(symbol)
            models.recent[t % _EVERY, miss] = slot
            out.narrow(miss, *models.interval(miss, slot), models.all.take(miss), ids.inner.take(symbol), ids.share.take(symbol), ids.bits)
        models.update(m, hit, now)
    return out.finish()


def decode_blocks(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, ids: _Ids) -> np.ndarray:
    """(BLOCK, blocks) symbols from the words, each block's starting at ``first``."""
    n = len(sizes)
    models, coder = _Models(n, ids), _Reader(words, first)
    symbols = np.zeros((BLOCK, n), np.uint32)
    for t, m in enumerate(_live(sizes)):
        if t % _EVERY == 0:
            models.total_up(m)
        now, p = models.predict(m)
        hit = coder.bit(m, p)
        miss = np.flatnonzero(~hit)
        if len(miss):
            slot = models.slot(miss, coder.peek(miss, models.all.take(miss)))
            models.recent[t % _EVERY, miss] = slot
            place = coder.enter(miss, *models.interval(miss, slot), ids.bits)
            symbol = ids.at.take((slot << ids.bits) + place)
            coder.settle(miss, ids.inner.take(symbol), ids.share.take(symbol))
            now[miss] = symbol
        models.update(m, hit, now)
        symbols[t, :m] = now
    return symbols


def _count(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids that occur, ascending; how often; and which of them each is."""
    if len(ids) and ids.max() < _DENSE:
        freq = np.bincount(ids)
        known = np.flatnonzero(freq)
        place = np.zeros(len(freq), np.uint32)
        place[known] = np.arange(len(known))
        return known.astype(np.uint32), freq[known], place.take(ids)
    known, place, freq = np.unique(ids, return_inverse=True, return_counts=True)
    return known, freq, place


def write_segment(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """One segment with the ids of whole documents."""
    sizes = np.array([len(d) for d in docs], np.uint64)
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    known, freq, place = _count(ids)
    freq = np.maximum(1, freq >> max(0, len(ids).bit_length() - _MOST.bit_length()))
    model = _Ids(known, freq)
    words = zlib.compress(np.diff(known, prepend=known[:0].dtype.type(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    n = -(-len(ids) // BLOCK)
    padded = np.zeros(n * BLOCK, np.uint32)
    padded[: len(ids)] = model.symbol.take(place)
    padded = padded.reshape(n, BLOCK)
    counts = np.full(n, BLOCK, np.int64)
    if n:
        counts[-1] = len(ids) - (n - 1) * BLOCK
    blocks: list[np.ndarray] = []
    for k in range(0, n, LANES):
        blocks += encode_blocks(np.ascontiguousarray(padded[k:k + LANES].T), counts[k:k + LANES], model)
    payload = [b.astype("<u4").tobytes() for b in blocks]
    table = np.array([(c, len(p) // 4, zlib.crc32(p)) for c, p in zip(counts, payload)], "<u4").reshape(n, 3)
    return b"".join([b"IDS3", struct.pack("<IQQQIII", BLOCK, len(docs), len(ids), n, len(known), len(words), zlib.crc32(words)),
                     np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
                     np.array([i is not None for i in doc_ids], "u1").tobytes(), sizes.astype("<u8").tobytes(),
                     words, table.tobytes(), *payload])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, their sizes, all ids) of a segment; a block that fails its
    checksum is an error."""
    if data[:4] != b"IDS3":
        raise ValueError("not a segment of token ids")
    block, n_docs, n_ids, n, n_known, n_bytes, crc = struct.unpack_from("<IQQQIII", data, 4)
    at = 4 + struct.calcsize("<IQQQIII")
    take = lambda kind, count: np.frombuffer(data, kind, count, at)
    keys = take("<i8", n_docs)
    at += keys.nbytes
    has = take("u1", n_docs)
    at += has.nbytes
    sizes = take("<u8", n_docs).astype(np.int64)
    at += 8 * n_docs
    packed = data[at:at + n_bytes]
    if zlib.crc32(packed) != crc:
        raise ValueError("the table of ids fails its checksum")
    known = np.frombuffer(zlib.decompress(packed), "<u4").reshape(2, n_known).astype(np.int64)
    model = _Ids(np.cumsum(known[0]), known[1])
    at += n_bytes
    table = take("<u4", 3 * n).reshape(n, 3).astype(np.int64)
    at += 12 * n
    words = take("<u4", (len(data) - at) // 4)
    first = np.concatenate(([0], np.cumsum(table[:, 1])))
    for k in range(n):
        if zlib.crc32(words[first[k]:first[k + 1]]) != table[k, 2]:
            raise ValueError(f"block {k} fails its checksum")
    words = np.concatenate((words, np.zeros(8, np.uint32)))
    parts = [decode_blocks(words, first[k:min(k + LANES, n)], table[k:k + LANES, 0], model).T.ravel() for k in range(0, n, LANES)]
    ids = model.ids.take(np.concatenate(parts)[:n_ids]) if parts else np.zeros(0, np.int64)
    return [int(i) if h else None for i, h in zip(keys, has)], sizes, ids


_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = range(5)


class _Splitter:
    """The matches of public_tokenizers.PATTERN in whole lots of texts, by the
    kinds of neighbouring characters."""

    def __init__(self):
        import regex

        self.classes = [(kind, regex.compile(c)) for kind, c in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s"))]
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)

    def kinds(self, chars: np.ndarray) -> np.ndarray:
        kinds = self.kind.take(chars)
        if (kinds == _UNKNOWN).any():
            for c in np.unique(chars[kinds == _UNKNOWN]).tolist():
                self.kind[c] = next((kind for kind, r in self.classes if r.fullmatch(chr(c))), _OTHER)
            kinds = self.kind.take(chars)
        return kinds

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The matches of all texts in order, and how many each text has."""
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        n, ends = len(chars), np.cumsum([len(t) for t in texts], dtype=np.int64)
        if not n:
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        kinds = self.kinds(chars)
        first = np.zeros(n + 1, bool)
        first[0] = True
        first[ends] = True
        start = first.copy()  # of a match
        start[1:n] |= kinds[1:] != kinds[:-1]
        # Of a run of spaces before something else the last character stands
        # alone, and a blank goes with what follows.
        space = kinds == _SPACE
        last = space[:-1] & ~space[1:] & ~first[1:n]
        start[:n - 1] |= last
        start[1:n] &= ~(last & (chars[:-1] == 32))
        # 's 't 'm 'd 're 've 'll, of an apostrophe that begins a match
        at = np.flatnonzero(chars == 39)
        at = at[start[at]]
        ahead = [np.where(at + k < n, chars.take(at + k, mode="clip"), 0) for k in (1, 2)]
        inside = [~first[np.minimum(at + k, n)] for k in (1, 2)]
        one = inside[0] & np.isin(ahead[0], [ord(c) for c in "stmd"])
        two = inside[0] & inside[1] & np.isin(ahead[0] << np.uint32(8) | ahead[1], [ord(c) << 8 | ord(d) for c, d in ("re", "ve", "ll")])
        for found, size in ((one, 2), (two, 3)):
            start[at[found] + 1] = False
            start[at[found] + size] = True
        places = np.flatnonzero(start)  # the last is the end
        counts = np.diff(np.searchsorted(places, ends), prepend=0)
        raw = joined.encode()
        if len(raw) != n:
            width = np.ones(n + 1, np.int8)
            for least in (0x80, 0x800, 0x10000):
                width[1:] += chars >= least
            width[0] = 0
            places = np.cumsum(width, dtype=np.int64)[places]
        return pa.Array.from_buffers(pa.large_string(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw)]), counts


def _byte_alphabet() -> dict[int, int]:
    """The letter that byte-level models have for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip(shown, shown)) | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


class Tokenizer:
    """Ids by the tokenizers library.  The library's split pattern is applied
    here, so that each distinct match is encoded by it once; texts that hold an
    added token go to the library whole."""

    def __init__(self, path: str, pattern: str, cache: int = 500_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import ByteLevel

        self.library, self.pattern, self.limit = Library.from_file(path), regex.compile(pattern), cache
        self.split = _Splitter().split if pattern == public_tokenizers.PATTERN else self._by_pattern
        before = self.library.pre_tokenizer
        self.plain = self.library.normalizer is None and isinstance(before, ByteLevel) and not before.add_prefix_space
        self.model, self.alphabet = self.library.model, _byte_alphabet()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def match_ids(self, matches: list[str]) -> tuple[list[int], list[int]]:
        """The library's ids of matches, and how many each has.  If all it does
        before its model is to split into matches and to write bytes as letters,
        its model is asked."""
        out: list[int] = []
        sizes = []
        if not self.plain:
            for m in matches:
                ids = self.library.encode(m, add_special_tokens=False).ids
                out += ids
                sizes.append(len(ids))
            return out, sizes
        tokenize, alphabet = self.model.tokenize, self.alphabet
        for m in matches:
            tokens = tokenize(m.encode().decode("latin-1").translate(alphabet))
            out += [t.id for t in tokens]
            sizes.append(len(tokens))
        return out, sizes

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # a match's place in first, which says where its ids begin
        self.first, self.ids, self.chars = np.zeros(1, np.int64), np.zeros(0, np.uint32), 0

    def _by_pattern(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        found = [self.pattern.findall(t) for t in texts]
        return pa.array([m for f in found for m in f], pa.large_string()), np.array([len(f) for f in found], np.int64)

    def _places(self, matches: list[str]) -> np.ndarray:
        if len(self.known) > self.limit or self.chars > 32 * self.limit:
            self._forget()
        new = [m for m in matches if m not in self.known]
        if new:
            ids, sizes = self.match_ids(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, np.array(ids, np.uint32)))
            self.chars += sum(map(len, new))
        return np.array([self.known[m] for m in matches], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        whole = {k: t for k, t in enumerate(texts) if any(a in t for a in self.added)}
        matches, counts = self.split([t if k not in whole else "" for k, t in enumerate(texts)])
        coded = matches.dictionary_encode()
        places = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist()).take(coded.indices.to_numpy())
        first, sizes = self.first.take(places), (self.first[1:] - self.first[:-1]).take(places)
        ends = np.cumsum(sizes)
        ids = self.ids.take(np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0))
        out = np.split(ids, np.concatenate(([0], ends))[np.cumsum(counts)[:-1]])
        for k, t in whole.items():
            out[k] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
        return out


def write_ids(docs: DataFrame, path: str | None = None, pattern: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode all documents in ascending doc_id order and write segments; the
    stored table of (part, seq, n_ids, segment)."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("segment", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, seq = Tokenizer(path, pattern), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def segment() -> pa.RecordBatch:
            row = [part], [seq], [held], [write_segment(keys, ids)]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for part_of in (p for batch in batches for p in pieces(batch, 1, _LOT_BYTES)):
            texts = [t or "" for t in part_of.column(1).to_pylist()]
            for key, own in zip(part_of.column(0).to_pylist(), tokenizer.encode(texts)):
                own = np.append(own, np.uint32(end_id))
                keys.append(key)
                ids.append(own)
                held += len(own)
                if held >= SEGMENT_IDS:
                    yield segment()
                    seq, keys, ids, held = seq + 1, [], [], 0
        if keys:
            yield segment()

    ordered = (keyed_text(docs).withColumn("__tie", F.monotonically_increasing_id())
               .repartitionByRange("doc_id", "__tie").drop("__tie").sortWithinPartitions("doc_id"))
    return stored(ordered.mapInArrow(run, "part int, seq int, n_ids long, segment binary"), "token-ids")


def read_ids(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the segments."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a task of the writer
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    starts = segments.select("part", "seq", F.coalesce(
        F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0)).alias("offset"))
    starts = starts.join(parts, "part").select("part", "seq", (F.col("base") + F.col("offset")).alias("start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, sizes, ids = read_segment(data.as_py())
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[e - s:e].tobytes()) for s, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - sizes),
                                                  pa.array(sizes), pa.array(crc, pa.int64())], schema=schema)

    return (segments.join(starts, ["part", "seq"]).select("start", "segment")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))
