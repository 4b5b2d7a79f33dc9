import random
import re

import pytest

from riskscope.llm import jaccard
from riskscope.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(pairs):
    sets = [grams(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            same = pairs[i][0] is not None and pairs[i][0] == pairs[j][0] and sets[i] and sets[j]
            common = len(sets[i] & sets[j])
            if same or sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        least.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(pairs):
        ids = [x for x in least[find(i)] if x is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


def check(make_docs, pairs):
    rows = jaccard.near_duplicates(make_docs(pairs).repartition(3)).collect()
    assert sorted(map(tuple, rows), key=str) == brute(pairs)


def test_odd_rows(make_docs, odd_texts):
    check(make_docs, odd_texts + [(70, "One two THREE four five six seven eight nine ten eleven"), (71, "a b"), (72, "A  B")])
    assert jaccard.near_duplicates(make_docs([])).collect() == []


def test_edited_copies_chains_and_a_shared_passage(make_docs):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    pairs = []
    for base in range(6):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 200]))]
        for copy in range(14):
            # Chains: every copy edits the one before, so ends are far apart.
            if copy % 3:
                for _ in range(rng.choice([0, 1, 1, 2])):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            pairs.append((1000 - len(pairs), " ".join(words) + (" " + passage if copy % 5 == 0 else "")))
    pairs += [(2000 + k, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 20])))) for k in range(25)]
    check(make_docs, pairs)


@pytest.mark.parametrize("block", [7, 1024])
def test_hot_groups_of_near_copies_that_do_not_all_link(make_docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(8)
    words = [f"v{k}" for k in range(120)]
    pairs = [(k, " ".join(words)) for k in range(30)]
    for k in range(90):
        own = list(words)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            own[rng.randrange(len(own))] = f"x{rng.random()}"
        pairs.append((100 + k, " ".join(own)))
    check(make_docs, pairs)


def test_real_texts(spark, make_docs, small_sf):
    check(make_docs, [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()])


def test_one_document_of_each_group_stays(make_docs):
    text = " ".join(f"w{k}" for k in range(30))
    docs = make_docs([(5, text), (3, text), (3, text), (9, text + " end"), (7, "another text of its own"), (8, None), (None, text)])
    left = jaccard.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([3, 7, 8, None], key=str)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 201), (201, 200), (205, 205)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(1, 61)} | {100 + k: 100 for k in range(1, 40)} | {201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
