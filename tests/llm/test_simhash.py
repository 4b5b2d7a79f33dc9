import itertools
import random
import re

import xxhash

from riskscope.llm.components import components
from riskscope.llm.simhash import fingerprint, links, near_duplicates


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(marks, reach=3):
    """Fingerprint -> its component, by comparing all pairs."""
    root = {m: m for m in marks}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(marks, 2):
        if bin(a ^ b).count("1") <= reach:
            root[top(a)] = top(b)
    out = {}
    for m in marks:
        out.setdefault(top(m), set()).add(m)
    return out.values()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(odd_texts):
    for _, text in odd_texts + [(0, "A b"), (0, "a B c D"), (0, "x\x0by\x0cz\x1cw v"), (0, "É " * 40000)]:
        assert fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)
    assert fingerprint(b"") == 0 == fingerprint(None)


def test_every_distance_and_place_of_the_bits(spark):
    """Pairs at 1 to 4 differing bits, in every split over the halves and both
    parities, and chains: the components are those of all pairs."""
    rng = random.Random(5)
    marks = {0, (1 << 64) - 1, 1 << 63, 7}
    for low in range(5):
        for high in range(5 - low):
            for _ in range(12):
                base = rng.getrandbits(64)
                flips = rng.sample(range(32), low) + [32 + b for b in rng.sample(range(32), high)]
                marks |= {base, base ^ sum(1 << b for b in flips)}
    chain = rng.getrandbits(64)
    for _ in range(12):
        marks.add(chain)
        chain ^= sum(1 << b for b in rng.sample(range(64), 3))
    hub = rng.getrandbits(64)   # a large group, round one fingerprint
    marks |= {hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    found = links(spark.createDataFrame([(signed(m),) for m in sorted(marks)], "fp long"))
    assert all(bin((r.a ^ r.b) & ((1 << 64) - 1)).count("1") <= 3 for r in found.collect())
    root = {r.node: r.root for r in components(found).collect()}
    got = {}
    for m in marks:
        got.setdefault(root.get(signed(m), signed(m)), set()).add(m)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups(marks)))


def expected(pairs):
    marks = [(i, plain_fingerprint(t)) for i, t in pairs]
    out = []
    for group in groups({m for _, m in marks}):
        ids = [i for i, m in marks if m in group and i is not None]
        out += [(i, f"{m:016x}", min(ids, default=None)) for i, m in marks if m in group]
    return sorted(out, key=repr)


def test_documents_equal_brute_force(spark, make_docs, odd_texts):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    pairs = list(odd_texts)
    for i in range(30):
        words = rng.choices(vocabulary, k=300)
        for j in range(4):
            copy = list(words)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            pairs.append((1000 + 4 * i + j, " ".join(copy)))
    pairs += [(5000 + i, "the very same words in all of these") for i in range(200)] + [(None, "the very same words in all of these")]
    docs = make_docs(pairs).withColumnRenamed("kept", "fp").repartition(6)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=repr) == expected(pairs)
    assert near_duplicates(make_docs([])).collect() == []


def test_null_ids_connect(spark, make_docs):
    assert sorted(map(tuple, near_duplicates(make_docs([(None, "a b c"), (None, "q r s t")])).collect()), key=repr) == expected(
        [(None, "a b c"), (None, "q r s t")])
