import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from riskscope.llm import repeats
from riskscope.llm.suffixes import common_prefixes, suffix_array


def brute(pairs):
    low = {}
    for d, t in pairs:
        b = (t or "").encode()
        key = -1 if d is None else d
        for k in range(len(b) - 49):
            w = b[k:k + 50]
            low[w] = min(low.get(w, key), key)
    out = []
    for d, t in pairs:
        b = (t or "").encode()
        key = -1 if d is None else d
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if low[b[k:k + 50]] < key:
                gone[k:k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(make_docs, pairs):
    rows = repeats.remove_repeats(make_docs(pairs).repartition(3)).collect()
    assert sorted(map(tuple, rows), key=str) == brute(pairs)


@pytest.mark.parametrize("alphabet", [3, 5, 256])
def test_suffix_array_and_common_prefixes(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 7, 60, 900):
        data = rng.integers(1, alphabet, n).astype(np.uint8)
        if n == 900:
            data[400:700] = data[100:400]
        raw = data.tobytes()
        order = suffix_array(data, 50)
        assert sorted(order) == list(range(n))
        heads = [raw[i:i + 50] for i in order]
        assert heads == sorted(heads)
        agree = common_prefixes(data, order, 50)
        for r in range(1, n):
            a, b = raw[order[r - 1]:], raw[order[r]:]
            exact = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert (agree[r] >= 50) == (exact >= 50) and agree[r] <= exact


def test_runs_merge_by_binary_search():
    make = lambda rows: np.array([(w.ljust(50, b"."), d, 0, 0, 0) for w, d in sorted(rows)], repeats._RUN)
    runs = [make([(b"a", 5), (b"c", 2)]), make([(b"a", 3), (b"b", 9)]), make([(b"b", 1), (b"b", 4), (b"c", 7)])]
    assert [list(x) for x in repeats.merge_runs(runs)] == [[3, 2], [3, 1], [1, 1, 2]]


def texts(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "é", "omega\n", "x"]
    line = " ".join(rng.choice(words) for _ in range(14))
    out = []
    for _ in range(n):
        body = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 10, 49, 50, 51, 120, 400])))
        if rng.random() < 0.6:
            cut = rng.randrange(len(line) // 3)
            body = body[:60] + line[cut:] + body[60:]
        if out and rng.random() < 0.4:
            other = rng.choice(out)
            a = rng.randrange(len(other) + 1)
            body += other[a:a + rng.choice([30, 49, 50, 51, 90, 1000])] + body[:20]
        out.append(body)
    return out


def test_random_texts_and_odd_rows(make_docs, odd_texts):
    rng = random.Random(9)
    ids = list(range(100, 260))
    rng.shuffle(ids)
    pairs = list(zip(ids, texts(rng, 160)))
    long = "the same line again and again and again and again, ok\n" * 60
    pairs += [(300, long), (301, "x" + long), (302, "y" * 300), (303, "y" * 70), (290, "ab" * 200), (304, "b" + "ab" * 40),
              (300, "another text with id 300 " + long[:200]), (300, long)]
    check(make_docs, odd_texts[:7] + odd_texts[9:] + pairs)
    assert repeats.remove_repeats(make_docs([])).collect() == []


def test_chunks_common_anchors_and_merged_shards(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", 10)
    monkeypatch.setattr(repeats, "MERGE_WINDOWS", 50)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    rng = random.Random(12)
    line = "Released under a licence that everybody knows by heart, and so on."
    pairs = [(k, t) for k, t in enumerate(texts(rng, 60))]
    for k in range(100, 160):
        noise = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 50)))
        pairs.append((k, noise + line + noise[::-1]))
    check(make_docs, pairs)


def noise(rng, n):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(n))


def asked(make_docs, pairs):
    rows = repeats._rows(make_docs(pairs))
    return sorted(r.doc_id for r in repeats._meet(rows, repeats._common_anchors(rows, len(pairs)), 8).where("not whole").collect())


def test_only_segments_with_a_common_core_are_asked_for(make_docs):
    rng = random.Random(21)
    line = noise(rng, 30)
    pairs = [(k, noise(rng, 60) + line + noise(rng, 60)) for k in range(15)]
    # An anchor in common, no 39 bytes: nothing to search; the same for a common anchor.
    assert asked(make_docs, pairs) == []
    assert asked(make_docs, pairs + [(k, noise(rng, 60) + line + noise(rng, 60)) for k in range(100, 140)]) == []
    # Repeats within one document take nothing.
    both = line + noise(rng, 20)
    assert asked(make_docs, pairs + [(50, noise(rng, 60) + both + noise(rng, 60) + both + noise(rng, 60))]) == []
    text = noise(rng, 60) + both + noise(rng, 60)
    assert set(asked(make_docs, pairs + [(50, text), (51, noise(rng, 60) + both + noise(rng, 60))])) == {50, 51}


def test_single_windows_wherever_their_anchor_stands(make_docs):
    rng = random.Random(22)
    pairs, places = [], set()
    for k in range(400):
        window = noise(rng, 50)
        pairs += [(k, noise(rng, rng.choice([0, 5, 20, 60])) + window + noise(rng, rng.choice([0, 5, 20, 60]))),
                  (1000 + k, noise(rng, 30) + window + noise(rng, 30))]
        places |= set(np.concatenate([a[-1] for a in repeats.anchors([window.encode()])]).tolist())
    assert places == set(range(repeats.REACH + 1))
    check(make_docs, pairs)


def test_common_anchor_with_rare_and_common_cores(make_docs):
    rng = random.Random(23)
    line, before, after = noise(rng, 26), noise(rng, 24), noise(rng, 24)
    pairs = []
    for k in range(120):
        if k % 3 == 0:  # as rare as a pair each
            side = noise(rng, 24)
            pairs += [(k, noise(rng, 60) + line + side + noise(rng, 60)), (500 + k, noise(rng, 60) + line + side + noise(rng, 60)),
                      (600 + k, noise(rng, 60) + side + line + noise(rng, 60)), (700 + k, noise(rng, 60) + side + line + noise(rng, 60)),
                      (800 + k, noise(rng, 60) + side + line + after + noise(rng, 60))]  # one core common, one rare
        pairs.append((200 + k, noise(rng, 60) + (before if k % 2 else "") + line + (after if k % 4 else "") + noise(rng, 60)))
    rows = repeats._rows(make_docs(pairs))
    known, cores = repeats._common_anchors(rows, len(pairs))
    assert len(known) and len(cores)
    check(make_docs, pairs)
    check(make_docs, pairs + [(None, pairs[0][1]), (None, pairs[3][1] + "x"), *pairs[:9]])


def test_texts_side_by_side_have_the_anchors_of_single_ones(monkeypatch):
    rng = random.Random(24)
    odd = [b"", b"x" * 49, b"y" * 50, bytes(60), bytes(16), b"z" * 60 + bytes(10), bytes(6) + b"z" * 60]
    many = odd + [t.encode() for t in texts(rng, 60)] + odd
    found = lambda lots: sorted({row for lot in lots for row in zip(*(x.tolist() for x in lot))})
    single = sorted({(k, *row[1:]) for k, t in enumerate(many) for row in found(repeats.anchors([t]))})
    assert found(repeats.anchors(many)) == single
    monkeypatch.setattr(repeats, "CHUNK", 64)
    assert found(repeats.anchors(many)) == single


def test_an_anchor_is_merged_in_as_many_pieces_as_its_own_windows_fill(monkeypatch):
    monkeypatch.setattr(repeats, "MERGE_WINDOWS", 4 * (repeats.REACH + 1) * repeats.SHARD_SEGMENTS)
    rng = random.Random(25)
    n = 40
    table = pa.table({"anchor": pa.array([1] * n), "seg": pa.array(range(n)), "doc_id": pa.array(range(n)), "at": pa.array([34] * n),
                      "bytes": pa.array([noise(rng, 84).encode() for _ in range(n)]), "parts": pa.array([8] * n)})
    runs = repeats.search_shard(table)
    assert set(runs.column("piece").to_pylist()) == {0, 1}


def test_real_texts(spark, make_docs, small_sf):
    check(make_docs, [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()])
