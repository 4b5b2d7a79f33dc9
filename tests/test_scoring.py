"""Scoring (E1-E7): softmax / argmax, the mapInPandas plug-in, keyed scores
with fallback, and distinct scoring."""
import numpy as np
from pyspark.sql import functions as F

from riskscope.operators import scoring as S


def _softmax(x):
    e = np.exp(np.asarray(x, dtype="float64") - np.max(x))
    return e / e.sum()


def test_score_logits_matches_numpy_and_first_wins(spark):
    logits = [[1.0, 2.0, 3.0, 0.5], [2.0, 2.0, 1.0, 0.0], [-1000.0, 0.0, 1000.0, 999.0]]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(logits)], "i int, logits array<double>")
    rows = S.score_logits(df, "logits").orderBy("i").collect()
    for r, l in zip(rows, logits):
        p = _softmax(l)
        assert np.allclose(r["ml_probs"], p, rtol=1e-12, atol=1e-15)
        assert r["ml_label_id"] == int(np.argmax(p)) and abs(r["ml_confidence"] - p.max()) < 1e-15
    assert rows[1]["ml_label_id"] == 0  # tie: the first class wins


def test_plugin_model_runs_per_batch(spark):
    def _model():  # local, so it is pickled by value for the Python workers
        import numpy as np

        def predict(texts):
            n = texts.str.len().to_numpy(dtype="float64")
            return np.stack([n, -n, n / 2.0, np.zeros_like(n)], axis=1)
        return predict

    texts = ["a", "abcd", "", "hello world"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    rows = {r["i"]: r["probs"] for r in S.score_with_model(df, "text", _model).collect()}
    for i, t in enumerate(texts):
        n = float(len(t))
        assert np.allclose(rows[i], _softmax([n, -n, n / 2.0, 0.0]))


def test_keyed_scores_fallback_and_distinct(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, text string")
    scores = spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4])], "doc_id long, probs array<double>")
    s = {r["doc_id"]: r for r in S.score_probs(S.attach_scores(docs, scores), "probs").collect()}
    assert s[1]["ml_label"] == "Highly Radical" and not s[1]["ml_missing"]
    assert s[2]["ml_missing"] and s[2]["ml_probs"] == [0.5, 0.2, 0.2, 0.1]
    calls = S.score_distinct(docs, "text", lambda u: u.withColumn(
        "probs", F.when(F.col("text") == "x", F.array(*[F.lit(v) for v in (0.0, 1.0, 0.0, 0.0)]))))
    got = {r["doc_id"]: r["probs"] for r in calls.collect()}
    assert got[1] == got[3] == [0.0, 1.0, 0.0, 0.0] and got[2] is None
    fg = S.fine_grained_scores(S.score_probs(docs.withColumn("probs", F.lit(None).cast("array<double>"))))
    assert fg.count() == 12 and fg.filter("label_id = 0").first()["prob"] == 0.5


def test_distinct_scoring_with_repeated_and_null_keys(spark):
    """Keys that repeat, keys that are null, equal texts under several keys: every
    row has its own text's score, once."""
    rows = [(1, "a"), (1, "bb"), (2, "a"), (3, None), (None, "a"), (None, "ccc"), (4, None)] + [(7, "hot")] * 200
    rows += [(100 + i, f"text number {i}" * (i % 5 + 1)) for i in range(300)] + [(900 + i, f"twice {i % 40}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    scorer = lambda u: u.withColumn("probs", F.array(F.length("text").cast("double")))
    for limit in (1 << 20, 0):   # by exact filters, and by a join
        got = S.score_distinct(df, "text", scorer, max_filter_bytes=limit).collect()
        key = lambda r: repr((r[0], r[1]))
        assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(rows, key=key)
        assert all((r.probs == [None] if r.text is None else r.probs == [float(len(r.text))]) for r in got)
    once = S.score_distinct(df, "text", scorer).where("text like 'text number%'")
    assert once.count() == 300
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.score_distinct(empty, "text", scorer).collect() == []


def test_distinct_scoring_moves_no_text(spark):
    df = spark.createDataFrame([(i, f"text {i % 70}") for i in range(100)], "doc_id long, text string")
    out = S.score_distinct(df, "text", lambda u: u.withColumn("probs", F.array(F.length("text").cast("double")))).select("doc_id", "probs")
    plan = out._jdf.queryExecution().executedPlan().toString()
    inputs = [line for line in plan.split("\n") if "Exchange" in line]
    assert inputs
    tree = out._jdf.queryExecution().sparkPlan()

    def exchanges(node):
        if "Exchange" in node.nodeName():
            yield [a.name() for a in map(node.output().apply, range(node.output().size()))]
        for i in range(node.children().size()):
            yield from exchanges(node.children().apply(i))

    prepared = out._jdf.queryExecution().executedPlan()
    prepared = prepared.initialPlan() if prepared.nodeName().startswith("AdaptiveSparkPlan") else prepared
    carried = [names for names in exchanges(prepared)]
    assert carried and not any("text" in names for names in carried), carried
    assert tree is not None


def test_exact_filter(spark):
    from riskscope.operators.membership import cascade, key_pair
    ids = spark.range(20000)
    members, others = ids.where("id % 3 = 0"), ids.where("id % 3 <> 0")
    pair = lambda d: d.select(*key_pair(F.col("id")))
    test = cascade(pair(members), pair(others))
    assert 1 < len(test.levels) < 10
    for literal_words in (0, 1 << 16):   # on Arrow batches, and as literals
        found = ids.withColumn("m", test.test(spark, *key_pair(F.col("id")), literal_words))
        assert found.where("m is null or m <> (id % 3 = 0)").count() == 0
    assert cascade(pair(members), pair(others), max_bytes=10) is None


def test_plugin_model_gets_slices_of_bounded_bytes(spark):
    def _model():
        import numpy as np

        def predict(texts):
            assert texts.name == "text"
            size = texts.map(lambda t: 0 if t is None else len(t.encode())).to_numpy(dtype="float64")
            return np.stack([np.full(len(size), np.log(len(size))), np.log(size + 1.0), np.zeros(len(size)), np.full(len(size), np.log(size.sum() + 1.0))], axis=1)
        return predict

    texts = ["é" * 25_000 if i % 10 else None for i in range(200)] + ["x" * 5_000_000, "", "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1).withColumn("more", F.lit("kept"))
    out = S.score_with_model(df, "text", _model)
    assert out.columns == ["i", "text", "more", "probs"]
    rows = out.collect()
    assert [(r.i, r.text, r.more) for r in rows] == [(i, t, "kept") for i, t in enumerate(texts)]
    for r, t in zip(rows, texts):
        n, own, one, whole = (p / r.probs[2] for p in r.probs)
        assert round(own) == len((t or "").encode()) + 1
        assert whole < (2 << 20) + 2 or round(n) == 1 or round(whole) == round(own), (r.i, n, whole)
    assert S.score_with_model(df.where("i < 0"), "text", _model).collect() == []


def test_plugin_model_moves_texts_alone_and_scores_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def _model():
        import numpy as np

        def predict(texts):
            calls.add(len(texts))
            size = texts.str.len().to_numpy(dtype="float64")  # no number for a null text
            return np.stack([size, size * 0, size * 0, size * 0], axis=1)
        return predict

    df = spark.createDataFrame([(1, "aa", "p"), (2, None, "q"), (3, "", "r")], "i int, text string, more string")
    out = S.score_probs(S.score_with_model(df, "text", _model), "probs").where("ml_confidence > 0.3")
    assert "[run(text" in out._jdf.queryExecution().executedPlan().toString().replace("cast(", "")
    assert sorted(r.i for r in out.collect()) == [1] and calls.value == 3
    assert [r.probs for r in S.score_with_model(df, "text", _model).where("i = 2").collect()] == [[None] * 4]
