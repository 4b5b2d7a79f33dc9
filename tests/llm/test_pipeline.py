import random
import tempfile

import public_tokenizers as P
import tiktoken
from test_decontaminate import brute as contaminated
from test_jaccard import brute as near_copies
from test_pii import EMAIL

import __spark_entry__
import corpus_pipeline
from riskscope.llm import bpe, quality


def fixture(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ta", "re", "mo", "li", "é"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    bench = [(k, prose(30)) for k in range(3)] + [(9, None)]
    docs = [(k, prose(rng.randint(25, 90))) for k in range(60)]
    docs += [(100 + k, docs[k][1] + (" end" if k % 2 else "")) for k in range(12)]                # near copies
    docs += [(200 + k, prose(20) + " " + bench[k][1][: 200] + " " + prose(20)) for k in range(3)]  # contaminated
    docs += [(300 + k, " ".join(word() + "###" for _ in range(60))) for k in range(20)]            # junk
    docs += [(400, prose(30) + " jo@site.com " + prose(5)), (401, None), (402, ""), (403, "short text")]
    rng.shuffle(docs)
    path = tempfile.mkdtemp(prefix="riskscope-test-")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)] + [(300 + k, 0, 0) for k in range(8)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, bench


def test_run_equals_the_stages_by_brute_force(spark):
    path, docs, bench = fixture(spark)
    read = lambda t: spark.read.parquet(f"{path}/{t}.parquet")
    kept = {r.doc_id for r in quality.assess(read("documents"), read("labels")).where("kept").collect()}
    assert kept == {i for i, t in docs if not 300 <= i < 400 and i < 401}
    left = [(i, t) for i, t in docs if i in kept]
    left = [(i, t) for i, t in left if (i, i) in {(d, c) for d, _, c in near_copies(left)}]
    assert not any(100 <= i < 112 for i, _ in left)
    bad = {r[0] for r in contaminated(left, bench) if r[5]}
    assert bad == {200, 201, 202}
    left = [(i, EMAIL.sub("<EMAIL>", t)) for i, t in left if i not in bad]
    ranks = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, path)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((i, library.encode_ordinary(t)) for i, t in left)


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    path, _, _ = fixture(spark)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            assert (out.count() > 0) == (frame is docs)


def test_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
