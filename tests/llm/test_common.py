import random

import pyarrow as pa

from riskscope.llm import decontaminate
from riskscope.llm.common import pieces
from riskscope.llm.pii import _merged, _overlaps


def test_pieces_hold_every_row_in_order():
    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "é" * rng.choice([0, 1, 40, 500]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts, pa.string())], names=["a", "text"]).slice(7)
    for limit in (1, 300, 10_000, 1 << 30):
        parts = list(pieces(batch, 1, limit))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts[7:]
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= limit for p in parts)
    assert list(pieces(batch.slice(0, 0), 1, 1))[0].num_rows == 0


def test_overlaps_equal_all_comparisons():
    rng = random.Random(2)
    for _ in range(300):
        spans = [(s, s + rng.randint(1, 6)) for s in rng.choices(range(60), k=rng.randint(0, 8))]
        merged = _merged(spans)
        for s in range(60):
            for e in (s + 1, s + 5):
                assert _overlaps(merged, s, e) == any(a < e and s < b for a, b in spans)


def test_the_broadcast_needs_no_installed_package():
    import pickle
    import pickletools

    rows = [(1, 10, 5, 7), (2, 3, 9, 9)]
    blob = pickle.dumps(decontaminate._index(rows))
    assert not any("riskscope" in str(arg) for _, arg, _ in pickletools.genops(blob))


def test_drop_contaminated_keeps_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words, 5), (2, "clean words only here", None), (None, "no id", 7)], "doc_id long, text string, __bad int")
    bench = spark.createDataFrame([(1, words)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == ["doc_id", "text", "__bad"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(2, "clean words only here", None), (None, "no id", 7)], key=repr)


def test_dense_texts_take_time_in_proportion():
    import time

    from riskscope.llm.pii import _with_added, base_spans, candidates

    def seconds(n):
        text = " ".join(f"user{i}@host{i}.example.org +1 (555) 010-{i % 10000:04d}" for i in range(n))
        began = time.perf_counter()
        base = base_spans(text)
        _with_added(base, candidates(text, base), frozenset(range(3 * 243 * 4)))
        return time.perf_counter() - began

    seconds(200)
    assert seconds(8000) < 16 * max(seconds(1000), 0.01)
