import zlib

import numpy as np

from riskscope.llm.sharding import jump_hash, shard_documents


def jump_one(key, shards):
    """The published loop, one key."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_published_loop():
    keys = np.array([0, 1, -1, 7, 2**62, -2**63, 123456789], np.int64)
    for n in (1, 2, 16, 1000):
        assert jump_hash(keys, n).tolist() == [jump_one(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20000)
    a, b = jump_hash(keys, 16), jump_hash(keys, 17)
    assert set(b[a != b]) == {16}
    assert abs((a != b).mean() - 1 / 17) < 0.01
    assert np.bincount(a).min() > 1000


def check(rows, pairs):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs)
    slots = {}
    for r in rows:
        assert r.law == "key" and r.shard == jump_one(r.doc_id or 0, 16) and r.grown_shard == jump_one(r.doc_id or 0, 17)
        slots.setdefault(r.shard, []).append(r)
    for s in slots.values():
        s.sort(key=lambda r: r.slot)
        assert [r.slot for r in s] == list(range(len(s)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in s]
        assert ids == sorted(ids)


def test_odd_rows_and_a_hot_key(spark, make_docs, odd_texts):
    pairs = odd_texts + [(3, "same key")] * 200 + [(i, f"t{i}") for i in range(100, 300)]
    check(shard_documents(make_docs(pairs).repartition(5)).collect(), pairs)
    assert shard_documents(make_docs([])).collect() == []
