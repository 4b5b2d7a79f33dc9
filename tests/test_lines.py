"""Ordered reading in splits: quoted CSV, dense numbers, digests."""
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from riskscope.sources import io, lines


@pytest.fixture()
def tiny_splits(spark):
    """Files are cut every 50 bytes or so."""
    names = {"spark.sql.files.maxPartitionBytes": "50", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def put(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return path


def both(spark, path):
    a = sorted(map(tuple, io.load_labeled_csv(spark, path).collect()), key=repr)
    b = sorted(map(tuple, io.load_labeled_csv(spark, path, splittable=False).collect()), key=repr)
    return a, b


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def test_splits_equal_the_whole_file_reader(spark, tmp_dir, tiny_splits):
    rng = random.Random(3)
    bits = ["a", " ", ",", '"', "\n", "é", "\n\n", '""', "NA", "'", "x" * 70]
    folder = os.path.join(tmp_dir, "csv")
    for k in range(3):
        rows = []
        for i in range(120):
            text = "".join(rng.choices(bits, k=rng.randint(0, 9)))
            rows.append((quoted(text) if i % 3 else str(rng.choice(["plain", "", "NA", "two words"]))) + f",{i % 4}")
        put(folder, f"f{k}.csv", ("﻿" if k == 1 else "") + "text,label\n" + "\n".join(rows) + ("\n" if k else ""))
    assert len(spark.read.text(folder).withColumn("p", F.spark_partition_id()).select("p").distinct().collect()) > 20
    a, b = both(spark, folder)
    assert a == b and len(a) == 360


@pytest.mark.parametrize("data", [
    'text,label\n"a\nb",1\n"c",2\n',
    'text,label\r\n"a, b",1\r\n\r\n"c",2\r\n',
    '\n\ntext,label\n\nx,1\n\n\ny,2\n',
    'text,label\n' + '"' + "line\n" * 100 + '",3\nlast,0',
    'text,label\n"' + "\n" * 200 + '","' + "\n" * 200 + '"\n',
    'text,label\n"text,label",1\ntext,label\n',
    'text,label\n',
    'a`b,"x,y"\n1,2\n',
    'text,label\nonly one field\na,b,c\n"",""\n',
])
def test_special_files(spark, tmp_dir, tiny_splits, data):
    path = put(tmp_dir, "a.csv", data)
    a, b = both(spark, path)
    assert a == b
    assert io.load_labeled_csv(spark, path).columns == io.load_labeled_csv(spark, path, splittable=False).columns


def test_joined_splits_without_a_broadcast(spark, tmp_dir, tiny_splits):
    path = put(tmp_dir, "a.csv", "text,label\n" + "".join(f'"row {i}\nmore ""{i}""",{i % 4}\n' for i in range(150)))
    near = sorted(map(tuple, lines.csv_records(spark, path).select("record", "head").collect()))
    far = sorted(map(tuple, lines.csv_records(spark, path, broadcast_splits=0).select("record", "head").collect()))
    assert near == far and len(near) == 151 and sum(r[1] for r in near) == 1


def test_quotes_that_do_not_pair_and_stray_quotes(spark, tmp_dir, tiny_splits):
    odd = put(tmp_dir, "odd.csv", 'text,label\n"never closed,1\nx,2\n')
    with pytest.raises(ValueError, match="do not pair"):
        io.load_labeled_csv(spark, odd)
    stray = put(tmp_dir, "stray.csv", 'text,label\n5" disk,1\nfoo,2\n6" disk,3\n')
    with pytest.raises(Exception, match="splittable=False"):
        io.load_labeled_csv(spark, stray).collect()
    assert io.load_labeled_csv(spark, stray, splittable=False).count() > 0


def test_dense_numbers_in_input_order(spark, tmp_dir, tiny_splits):
    folder = os.path.join(tmp_dir, "txt")
    expected = []
    for k in range(4):
        texts = [f"file {k} text {i}" if i % 7 else "   " for i in range(60)]
        put(folder, f"part-{k}.txt", "\n".join(texts) + "\n")
        expected += [t for t in texts if t.strip()]
    rows = io.read_texts(spark, folder, ".txt").collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.item_idx)] == expected
    assert sorted(r.item_idx for r in rows) == list(range(len(expected)))


def test_json_array_elements_one_by_one(spark, tmp_dir):
    items = [{"text": "one\n\"two\""}, 5, {"content": "c"}, "s", None, [1], {"text": None, "content": "d"}, {"text": 7}, {"x": 1}, {"text": "é\u0001"}]
    path = put(tmp_dir, "a.json", json.dumps(items))
    rows = sorted(io.read_texts(spark, path).collect(), key=lambda r: r.item_idx)
    assert [r.item_idx for r in rows] == list(range(10))
    assert [r.text for r in rows] == ["one\n\"two\"", None, "c", None, None, None, "d", "7", "", "é\u0001"]
    assert [r.malformed for r in rows] == [None, "5", None, '"s"', "null", "[1]", None, None, None, None]
    with pytest.raises(Exception, match="no JSON object"):
        io.read_texts(spark, path, strict=True).collect()
    broken = put(tmp_dir, "b.json", '[{"text": "a"}, {"text": ')
    (only,) = io.read_texts(spark, broken).collect()
    assert only.text is None and only.malformed.startswith("[")
    one = put(tmp_dir, "c.json", ' {"text": "single"}')
    assert [r.text for r in io.read_texts(spark, one).collect()] == ["single"]
    assert io.read_texts(spark, put(tmp_dir, "d.json", "[]")).collect() == []


def tree(body, fanout):
    level = [hashlib.sha256(x).hexdigest() for x in (body[:-1] if body.endswith(b"\n") else body).split(b"\n")]
    n = len(level)
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i:i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
    return hashlib.sha256(f"{len(body)}:{n}:{level[0]}".encode()).hexdigest()


def test_large_digests_keep_the_order(spark, tmp_dir, tiny_splits):
    folder = os.path.join(tmp_dir, "with space", "ü")
    body = b"".join(b"line %d\r\n" % (i * 7) for i in range(90)) + b"\xff\n\n\nlast"
    swapped = body.replace(b"line 7\r\nline 14\r\n", b"line 14\r\nline 7\r\n")
    files = {"a b.txt": body, "b%20.txt": swapped, "c.txt": body + b"\n", "d.txt": b"small", "e.txt": b"one line of more than twenty bytes"}
    for name, data in files.items():
        put(folder, name, data)
    got = {os.path.basename(r.path): r for r in io.file_digests(spark, folder, whole_file_bytes=20, fanout=4).collect()}
    assert len(got) == len(files) and len({r.sha256 for r in got.values()}) == len(files)
    for name, data in files.items():
        if name == "d.txt":
            assert (got[name].kind, got[name].sha256) == ("file", hashlib.sha256(data).hexdigest())
        else:
            assert (got[name].kind, got[name].sha256, got[name].size_bytes) == ("lines", tree(data, 4), len(data))


def test_sums_before(spark):
    rng = random.Random(1)
    rows = [(f"f{i % 9}", i, rng.randint(0, 5)) for i in range(300)]
    got = {(r.f, r.s): r.before for r in lines.sums_before(spark.createDataFrame(rows, "f string, s long, v long").repartition(7), ["f", "s"], "v", "before").collect()}
    total = 0
    for f, s, v in sorted(rows):
        assert got[f, s] == total
        total += v
