import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from riskscope.llm import idcoder


@pytest.mark.parametrize("kind", ["random", "constant", "cycle", "text", "wide"])
def test_segment_round_trip(kind):
    rng = np.random.default_rng(2)
    make = {"random": lambda n: rng.integers(0, 65536, n), "constant": lambda n: np.full(n, 50256),
            "cycle": lambda n: np.arange(n) % 7, "text": lambda n: np.minimum(rng.geometric(0.01, n), 65535),
            "wide": lambda n: np.where(rng.random(n) < 0.9, 3, rng.integers(0, 65536, n))}[kind]
    docs = [make(n).astype(np.uint32) for n in (0, 1, 1023, 1024, 1025, 5000, 2, 0)]
    keys = [None, 1, -5, 1 << 60, 7, 7, 8, 9]
    data = idcoder.write_segment(keys, docs)
    got, sizes, ids = idcoder.read_segment(data)
    assert got == keys and sizes.tolist() == [len(d) for d in docs]
    assert (ids == np.concatenate(docs)).all()


def test_checksums_and_bounds():
    data = bytearray(idcoder.write_segment([1], [np.arange(3000, dtype=np.uint32)]))
    data[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        idcoder.read_segment(bytes(data))
    table = bytearray(idcoder.write_segment([1], [np.arange(3000, dtype=np.uint32)]))
    table[4 + 40 + 8 + 1 + 8 + 5] ^= 1
    with pytest.raises(ValueError, match="table of ids"):
        idcoder.read_segment(bytes(table))
    with pytest.raises(ValueError):
        idcoder.read_segment(b"nope" + bytes(40))


def test_any_unsigned_id():
    rng = np.random.default_rng(5)
    wide = rng.integers(0, 1 << 32, 3000).astype(np.uint32)
    docs = [np.array([70000, (1 << 32) - 1, 0, 65535, 65536], np.uint32), wide, np.concatenate((wide[:500], wide[:500]))]
    _, sizes, ids = idcoder.read_segment(idcoder.write_segment([1, 2, 3], docs))
    assert (ids == np.concatenate(docs)).all() and sizes.tolist() == [5, 3000, 1000]


def test_few_lanes_of_many_ids_keep_frequencies_bounded(monkeypatch):
    monkeypatch.setattr(idcoder, "_MOST", 1 << 8)  # as for a document of more than 2^24 ids
    ids = np.minimum(np.random.default_rng(3).geometric(0.02, 9000), 900).astype(np.uint32)
    assert (idcoder.read_segment(idcoder.write_segment([1], [ids]))[2] == ids).all()


def test_order_0_adapts_and_beats_the_frequencies():
    """Blocks that differ in their ids cost less than the frequencies of all."""
    rng = np.random.default_rng(4)
    docs = [(rng.zipf(1.3, 1024).clip(1, 300) * 7 + 1000 * (k % 5)).astype(np.uint32) for k in range(40)]
    ids = np.concatenate(docs)
    _, n = np.unique(ids, return_counts=True)
    entropy = -(n * np.log2(n / len(ids))).sum() / 8
    assert len(idcoder.write_segment(list(range(40)), docs)) < entropy


def test_repeats_are_coded_short():
    data = idcoder.write_segment([1], [np.tile(np.arange(50, dtype=np.uint32), 400)])
    assert len(data) < 20000 * 2 / 5


def test_query_on_odd_and_real_rows(spark, make_docs, odd_texts, small_sf):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()]
    for pairs in (odd_texts + [(20, "a <|endoftext|> b")], real, []):
        rows = idcoder.read_ids(idcoder.write_ids(make_docs(pairs).repartition(3))).collect()
        want = []
        for i, t in pairs:
            ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            want.append((i, len(ids), zlib.crc32(ids.tobytes())))
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_shares_wider_than_a_range_has_left(monkeypatch):
    """More ids in a slot than fit beside it: slot and share are coded apart."""
    rng = np.random.default_rng(6)
    ids = np.concatenate((np.arange(40000), rng.integers(0, 90000, 20000), np.full(3000, 7))).astype(np.uint32)
    for joint in (idcoder._JOINT, 0):
        monkeypatch.setattr(idcoder, "_JOINT", joint)
        assert (idcoder.read_segment(idcoder.write_segment([1], [ids]))[2] == ids).all()


def test_lots_are_split_as_by_the_pattern():
    rng = np.random.default_rng(7)
    parts = ["'", "s", "t", "re", "ve", "ll", "l", "m", "d", "S", " ", "  ", "\n", "\t", "1", "\u00b2", "\u00e9", "\u4e2d", "\u2603", "\U0001f600",
             "\u00a0", "\u3000", "\u0301", "x", "!", "''"]
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), n)) for n in rng.integers(0, 14, 20000)]
    tokenizer = idcoder.Tokenizer(P.path("byte_bpe_50k.json"), P.PATTERN)
    matches, counts = tokenizer.split(texts)
    want = [tokenizer.pattern.findall(t) for t in texts]
    assert matches.to_pylist() == [m for w in want for m in w] and counts.tolist() == [len(w) for w in want]
    again = tokenizer._by_pattern(texts)
    assert again[0].equals(matches) and (again[1] == counts).all()


@pytest.mark.parametrize("limit", [500_000, 3])
def test_lots_have_the_library_s_ids(odd_texts, limit):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [t or "" for _, t in odd_texts] + ["a <|endoftext|> b", "it's\u00a0they'll''ve \x00\x7f\u00ad"]
    tokenizer = idcoder.Tokenizer(P.path("byte_bpe_50k.json"), P.PATTERN, limit)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [i.tolist() for i in tokenizer.encode(texts)] == want
        assert [i.tolist() for t in texts for i in tokenizer.encode([t])] == want
    assert tokenizer.encode([]) == []
    tokenizer.plain = False  # as for a library that does more before its model
    tokenizer._forget()
    assert [i.tolist() for i in tokenizer.encode(texts)] == want
