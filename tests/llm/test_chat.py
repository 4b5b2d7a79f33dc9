import hashlib

from pyspark.sql import functions as F

from riskscope.llm.chat import Template, format_turns, read_back


def conv(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows],
                                 "conv_id long, turn long, role string, text string, segment int, loss string")


def want(rows, template=Template()):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    got = []
    for c, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        got.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(got, key=str)


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[IN\\ST]", "[INST", "</s", "<", "[/ROLE]x[/TURN]", "[[INST]]", "a\\[INST] \\", "é☃\U0001f600", "", " "]


def test_round_trip_of_control_strings_and_odd_rows(spark):
    rows = [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]
    for k, text in enumerate(NASTY):
        rows += [(k, 0, "system", text), (k, 1, "user", text + "[INST]"), (k, 2, "assistant", text)]
    rows += [(50, 0, None, None), (50, 0, None, None), (51, None, "to\\ol[/ROLE]", "x"), (51, 1, "assistant", None),
             (None, 3, "user", "null id"), (52, 0, "user", "x" * 100000), (53, 1, "b", "t"), (53, 1, "a", "t")]
    got = read_back(format_turns(conv(spark, rows))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want(rows)
    valid = {r.conv_id: r.valid for r in got}
    assert valid[-7] and valid[0] and not valid[50] and not valid[52] and not valid[51]
    assert read_back(format_turns(conv(spark, []))).collect() == []


def test_segments_hold_no_unescaped_control_string(spark):
    template = Template()
    rows = [(1, 0, "user", t) for t in NASTY]
    bodies = format_turns(conv(spark, rows)).where("segment_no = 1").select("segment", "loss").collect()
    for b in bodies:
        assert not b.loss and not any(c in b.segment for c in template.controls())


def test_long_conversation_streams_over_batches(spark):
    n = 30000
    frame = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                  F.col("id").cast("string").alias("text"))
    row = read_back(format_turns(frame)).collect()
    assert len(row) == 1 and row[0].n_turns == n and row[0].valid
    assert row[0].loss_sha256 == hashlib.sha256("".join(map(str, range(1, n, 2))).encode()).hexdigest()
