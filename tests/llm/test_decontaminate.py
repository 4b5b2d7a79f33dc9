import hashlib
import random
import re

from riskscope.llm.decontaminate import contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for j, b in items:
            v = words(b)
            n = min(10, len(v))
            wins = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(j)
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def bench_frame(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def both(spark, make_docs, docs, items):
    want = brute(docs, items)
    for limit in (1 << 30, -1):
        rows = contamination(make_docs(docs), bench_frame(spark, items), broadcast_bytes=limit).collect()
        assert sorted(map(tuple, rows), key=str) == want


def test_random_small_alphabet_and_odd_rows(spark, make_docs, odd_texts):
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice(["a", "B", "c1", "é"]) for _ in range(n))
    items = [(k, make(rng.choice([0, 1, 6, 7, 9, 10, 11, 25]))) for k in range(12)] + [
        (50, None), (51, "..."), (52, "One, two three FOUR five six seven eight nine ten"), (52, "seven eight nine ten eleven x y z w v")]
    both(spark, make_docs, odd_texts + [(100 + k, make(rng.randint(0, 60))) for k in range(60)], items)
    both(spark, make_docs, [], items)
    both(spark, make_docs, odd_texts, [])


def test_every_shared_span_of_ten_words_is_found(spark, make_docs, small_sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()]
    rng = random.Random(2)
    for k in range(40):
        w = words(items[k % len(items)][1])
        s = rng.randint(0, max(0, len(w) - 10))
        docs.append((5000 + k, "aa bb " + " - ".join(w[s:s + rng.choice([9, 10, 14])]).upper() + " cc dd"))
    both(spark, make_docs, docs, items)


def test_drop_keeps_columns_and_clean_rows(spark, make_docs):
    items = bench_frame(spark, [(1, "one two three four five six seven eight nine ten")])
    docs = make_docs([(1, "x one two three four five six seven eight nine ten"), (2, "one two"), (None, None)])
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, None}
