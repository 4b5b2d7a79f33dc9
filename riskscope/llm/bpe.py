"""Byte-level BPE encoding and decoding (operator 5): monoid tree reduction.

A text is cut in halves down to leaves, each leaf is encoded, and neighbours
are joined going up.  The join is associative: it encodes a window around the
seam again and grows it until both edges are proven, then keeps the tokens
outside as they are.

* With the standard split pattern, a space between two characters that are not
  white space starts a match whatever stands around it: no match goes on from
  such a character over a space, and none before it looks further ahead.  So the
  window grows from the seam, token by token to either side, until such a place
  lies between its outermost token and the next one outside; it is encoded as it
  would be within the whole text, and the tokens outside are final.  Where the
  seam is such a place itself, both sides stay as they are.
* Where a window has grown over eight leaves, or with another pattern, matches are joined:
  the left part's last matches may change when text follows, so the join scans
  again from the first match that could see the end of the left part, over a
  window that doubles until a match boundary of the scan meets one of the right
  part.  The pattern looks at most two characters past a match's start for a
  contraction and one past its end, and never back, so matches outside the
  window are final.
* Inside one long match, tokens are joined: the window around the seam grows
  until, at both edges, the outer and the inner token encode to themselves as a
  pair.  A sequence of tokens whose adjacent pairs all encode to themselves is
  the encoding of the whole, so the tokens outside are final.

Decoding maps ids to bytes in the leaves and concatenates up the same tree.

Nulls and empty texts have no tokens.  Repeated rows and ties do not matter;
an empty table gives an empty result; other columns are ignored.  Strings of
special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskscope.llm.common import keyed_text, pieces

LEAF_CHARS = 256      # texts up to this long are one leaf
WINDOW_LEAVES = 8     # windows up to so many leaves are encoded at once
LEAF_BYTES = 48       # matches up to this long are merged directly
CACHE_MATCHES = 200_000
LOOKAHEAD = 3         # characters from its start that decide where a match begins and ends
# Fixed value: the split pattern whose seams are known.
STANDARD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]


def _closes(token: bytes) -> bool:
    """Whether the token's end shows that the character there is not white space."""
    last = token.decode("utf-8", "replace")[-1]
    if last != "\ufffd":
        return not last.isspace()
    return not any(w.endswith(token[-len(w):]) for w in _WHITE)


def _opens(token: bytes) -> bool:
    """Whether the token is a space and the start of a character that is not white space."""
    if token[:1] != b" " or len(token) < 2:
        return False
    first = token[1:].decode("utf-8", "replace")[0]
    if first != "\ufffd":
        return not first.isspace()
    return not any(w.startswith(token[1:1 + len(w)]) for w in _WHITE)


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TreeCodec:
    """Encodes and decodes with given ranks and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS,
                 leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern)
        self.standard = pattern == STANDARD_PATTERN
        self._closing = frozenset(i for b, i in ranks.items() if _closes(b))
        self._opening = frozenset(i for b, i in ranks.items() if _opens(b))
        self._leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary
        self.leaf_chars, self.leaf_bytes = max(leaf_chars, 2 * LOOKAHEAD), max(leaf_bytes, 2)
        self._cache: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> "TreeCodec":
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return cls(ranks, pattern)

    # --- tokens inside one match -------------------------------------------------

    def _merge(self, data: bytes) -> list[int]:
        """Plain BPE: the lowest-ranked adjacent pair merges first, the leftmost
        of equal ones."""
        if len(data) > 4 * LEAF_BYTES:
            return self._merge_queued(data)
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_queued(self, data: bytes) -> list[int]:
        """The same for long data, with a queue of pairs over a linked list."""
        n, ranks = len(data), self.ranks
        parts: list[bytes | None] = [data[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # a part of this pair has merged meanwhile
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    pair = parts[a] + parts[after[a]]
                    if (r := ranks.get(pair)) is not None:
                        heapq.heappush(queue, (r, a, len(pair)))
        return [ranks[p] for p in parts if p is not None]

    def _settled(self, a: int, b: int) -> bool:
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) >= CACHE_MATCHES:
                self._pairs.clear()
            got = self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self._pairs[a, b] = got
        return got

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring runs of bytes of one match."""
        if not left or not right or self._settled(left[-1], right[0]):
            return left + right
        i, j, step = len(left) - 1, 1, 1
        while True:
            window = b"".join(self.bytes_of[t] for t in left[i:] + right[:j])
            inner = self._merge(window)
            grow_left = i > 0 and not self._settled(left[i - 1], inner[0])
            grow_right = j < len(right) and not self._settled(inner[-1], right[j])
            if not grow_left and not grow_right:
                return left[:i] + inner + right[j:]
            i, j = max(0, i - step * grow_left), min(len(right), j + step * grow_right)
            step *= 2

    def _halves(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self._merge(data)
        mid = len(data) // 2
        return self.join_tokens(self._halves(data[:mid]), self._halves(data[mid:]))

    def match_tokens(self, match: str) -> tuple[int, ...]:
        got = self._cache.get(match)
        if got is None:
            got = tuple(self._halves(match.encode()))
            if len(match) <= 32:
                if len(self._cache) >= CACHE_MATCHES:
                    self._cache.clear()
                self._cache[match] = got
        return got

    # --- matches of a text -------------------------------------------------------

    def matches(self, text: str) -> list[str]:
        if len(text) <= self.leaf_chars:
            return self.split.findall(text)
        mid = len(text) // 2
        return self.join_matches(self.matches(text[:mid]), self.matches(text[mid:]))

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        # The first match of the left part that could see its end.
        cut, tail = len(left), 0
        while cut > 0 and (tail < LOOKAHEAD or cut == len(left)):
            cut -= 1
            tail += len(left[cut])
        seam = "".join(left[cut:])
        take = 1
        while True:
            window = seam + "".join(right[:take])
            whole = take >= len(right)
            found = self.split.findall(window)
            # Boundaries of the right part that lie in the window, by offset.
            edge, at = {len(seam): 0}, len(seam)
            for k, m in enumerate(right[:take]):
                at += len(m)
                edge[at] = k + 1
            at = 0
            for n, m in enumerate(found):
                if at in edge and (whole or at + LOOKAHEAD <= len(window)):
                    # Scanning from here, both parts see the same text.
                    return left[:cut] + found[:n] + right[edge[at]:]
                at += len(m)
                if not whole and at + LOOKAHEAD > len(window):
                    break
            if whole:
                return left[:cut] + found
            take *= 2

    # --- whole texts -------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        if not self.standard:
            return self._by_matches(text)
        if len(text) <= self.leaf_chars:
            return self._leaf(text)
        mid = len(text) // 2
        return self.join(self.encode(text[:mid]), self.encode(text[mid:]))

    def _by_matches(self, text: str) -> list[int]:
        out: list[int] = []
        get, tokens = self._cache.get, self.match_tokens
        for m in self.matches(text):
            out += get(m) or tokens(m)
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring parts of a text, from theirs alone."""
        if not left or not right or self._proven(left[-1], *right[:2]):
            return left + right
        i, j = len(left) - 1, 1
        after = right[0]
        while i > 0 and not self._proven(left[i - 1], left[i], after):
            after = left[i]
            i -= 1
        while j < len(right) and not self._proven(right[j - 1], *right[j:j + 2]):
            j += 1
        window = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])).decode()
        encode = self._leaf if len(window) <= WINDOW_LEAVES * self.leaf_chars else self._by_matches
        return left[:i] + encode(window) + right[j:]

    def _proven(self, a: int, b: int, after: int | None = None) -> bool:
        """Whether a match begins between two neighbouring tokens, whatever stands
        before the first; ``after`` are bytes known to follow the second."""
        if a not in self._closing:
            return False
        if b in self._opening:
            return True
        token = self.bytes_of[b]
        return after is not None and token[:1] == b" " and len(token) < 4 and _opens(token + self.bytes_of[after])

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_CODECS: dict[tuple[str, str], TreeCodec] = {}


def codec(path: str, pattern: str) -> TreeCodec:
    """One codec per Python worker and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = TreeCodec.load(path, pattern)
    return _CODECS[path, pattern]


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or default_ranks_path(), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) per document."""
    path, pattern = _vocabulary(path, pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in (p for b in batches for p in pieces(b, 1)):
            ids = [np.array(c.encode(t.as_py() or ""), np.int32) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([*ids, np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=schema)

    return keyed_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def digest(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """n_tokens, ids_sha256 and, of the decoded bytes, decoded_sha256."""
    path, pattern = _vocabulary(path, pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        names = [str(i) for i in range(max(c.bytes_of) + 1)]
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in batch.column(1):
                ids = row.as_py() or []
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                out[2].append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, f.type) for v, f in
                                                                 zip(out, list(schema)[1:]))], schema=schema)

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
