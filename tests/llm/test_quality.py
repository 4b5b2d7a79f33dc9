import re

from riskscope.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    twice, seen = set(), set()
    for x in wins:
        (twice if x in seen else seen).add(x)
    covered = {i + k for i, x in enumerate(wins) if x in twice for k in range(8)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep,
            n < 20 or 100 * rep > 30 * n)


def labels(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, quality int, toxic int, text string")


def test_base_measures_on_odd_and_real_rows(spark, make_docs, odd_texts, small_sf):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()]
    eight = "a b c d e f g h"
    extra = [(800, f"{eight} {eight}"), (801, f"x {eight} y z {eight} q {eight}"), (802, "a " * 40), (803, "l1 w\n\nl1 w\n \nl1 w\r\nl1 w"),
             (804, "a b " * 9), (805, "#*$%&|<> plain"), (806, " ".join(f"w{k}" for k in range(50)) + " " + eight + " t " + eight)]
    for pairs in (odd_texts + extra, real):
        rows = quality.assess(make_docs(pairs), labels(spark, [(1, 1), (None, 1), (5, 0)])).collect()
        got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
        assert sorted(got, key=str) == sorted([(i, *brute(t)) for i, t in pairs], key=str)
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality.assess(make_docs([]), labels(spark, [])).collect() == []


def test_score_is_the_ratio_of_two_hashed_multinomials(spark, make_docs):
    import math

    good = " ".join(f"good{k % 30}" for k in range(60))
    bad = " ".join(f"bad{k % 30}|" for k in range(60))
    pairs = [(k, good if k % 2 else bad) for k in range(40)]
    lab = labels(spark, [(k, k % 2) for k in range(20)])
    docs = make_docs(pairs)
    table = quality.weights(quality.keyed_text(docs), lab)
    grams = {r.doc_id: r.g for r in docs.select("doc_id", quality.let(quality._hashes(quality.tokens(docs.text)), quality._grams).alias("g")).collect()}
    raw, trusted = {}, {}
    for i, g in grams.items():
        for b in g:
            raw[b] = raw.get(b, 0) + 1
            if i < 20 and i % 2:
                trusted[b] = trusted.get(b, 0) + 1
    scale = sum(trusted.values()) / sum(raw.values())
    for b in raw:
        want = math.log((trusted.get(b, 0) + quality.SMOOTHING) / (raw[b] * scale + quality.SMOOTHING))
        assert abs(table[b] - 1e6 * want) < 1
    for r in quality.assess(docs, lab).collect():
        assert r.llr_micro == sum(table[b] for b in grams[r.doc_id])
    left = quality.keep_good(docs, lab)
    assert left.columns == docs.columns


def test_plan_is_native(spark, make_docs):
    frame = quality.assess(make_docs([(1, "a b")]), labels(spark, [(1, 1)]))
    plan = frame._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


def test_labelled_junk_goes_and_good_documents_stay(spark, small_sf):
    sf = small_sf.replace("0.001", "0.01")
    docs, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.assess(docs, lab).join(lab, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in junk) <= 0.1 * len(junk)
