import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from riskscope.llm.merkle import manifest, paths


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join(map(part, (doc_id, source, lang, n_chars, text))))


def levels(hashes, fanout):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, at, fanout):
    """(before, after) of each level below the root."""
    out = []
    for row in tree[:-1]:
        run = at // fanout * fanout
        out.append((row[run:at], row[at + 1:run + fanout]))
        at //= fanout
    return out


def expected(rows, fanout):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        built[lang] = levels([leaf(*r) for r in trees[lang]], fanout)
    crown = levels([built[lang][-1][0] for lang in langs], fanout)
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(trees[lang]):
            steps = siblings(built[lang], i, fanout) + siblings(crown, k, fanout)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = leaf(*r[:3], r[3] + 1, r[4]) if hit else leaf(*r)
            for before, after in steps:
                folded = sha("".join((*before, folded, *after)))
            proof = sha("".join(h for before, after in steps for h in before + after))
            out.append((r[0], leaf(*r), built[lang][-1][0], crown[-1][0], proof, folded, folded == crown[-1][0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 7, "t") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, "
        "tree string, pos long, item string")


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("fanout,block", [(2, 256), (2, 4), (3, 9), (5, 5)])
def test_manifest_equals_brute_force(spark, fanout, block):
    rows = [(i, f"s{i % 3}" if i % 5 else None, (None, "en", "de", "é", "")[i % 5 if i < 90 else 1],
             i * 3 if i % 4 else None, ("", None, "tëxt ☃", "a" * 5000)[i % 4]) for i in range(130)]
    rows += [(None, None, None, None, None), (None, "s", "en", 4, "x"), (7, "s", "en", 4, "x"), (5000, "s", "zz", 2, "only one")]
    rows += [rows[11]] * 40   # repeated rows
    got = [tuple(r) for r in manifest(frame(spark, rows).repartition(5), fanout, block).collect()]
    assert sorted(got, key=key) == sorted(expected(rows, fanout), key=key)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_one_row_and_none(spark):
    rows = [(3, "s", "en", 1, "x")]
    assert [tuple(r) for r in manifest(frame(spark, rows)).collect()] == expected(rows, 2)
    assert expected(rows, 2)[0][4] == sha("")
    assert manifest(frame(spark, [])).collect() == []


def test_a_tree_of_many_blocks(spark):
    """A tree that holds nearly all rows is dealt by block, not by tree."""
    leaves = spark.range(3000).select(F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("hash"),
                                      F.struct(F.col("id").alias("id")).alias("item"))
    tree = levels([sha(str(i)) for i in range(3000)], 2)
    rows = paths(leaves.withColumn("id", F.col("item.id")), ["id"], 2, 16).collect()
    assert len(rows) == 3000 and {r.root for r in rows} == {tree[-1][0]}
    for r in rows[::97]:
        assert [(s.left, s.right) for s in r.steps] == [("".join(a), "".join(b)) for a, b in siblings(tree, r.item.id, 2)]
