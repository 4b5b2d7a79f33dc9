import random
import re
from collections import Counter

from riskscope.llm import licenses


def pairs_of(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    return Counter(zip(w, w[1:]))


def brute(text):
    units = set(text.split("\n")) | set(re.split(r"\n[ \t\r\f\v]*\n", text)) | {text}
    hits, best = 0, None
    names = set()
    for u in units:
        a, found = pairs_of(u), False
        for name, t in licenses.TEMPLATES:
            b = pairs_of(t)
            if a and b:
                score = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
                if score >= licenses.THRESHOLD:
                    found = True
                    names.add(name)
                    if best is None or (-score, name) < best:
                        best = (-score, name)
        hits += found
    return (best and best[1], best and -best[0], hits, ",".join(sorted(names)))


def test_scan_equals_comparing_with_every_template(spark, make_docs, odd_texts, small_sf):
    rng = random.Random(6)
    pairs = list(odd_texts) + [(r.doc_id + 100, r.text) for r in
                               spark.read.parquet(f"{small_sf}/documents.parquet").collect()]
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        for _ in range(3):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 5))):
                own[rng.randrange(len(own))] = rng.choice(["other", "the", "License"])
            pairs.append((1000 + k, "Some prose.\n\n" + " ".join(own).upper() + "\n\nmore prose here"))
    rows = licenses.scan(make_docs(pairs)).collect()
    want = [(i, *brute(t or "")) for i, t in pairs]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert sum(r.license is not None for r in rows) > len(licenses.TEMPLATES)
    assert licenses.scan(make_docs([])).collect() == []


def test_full_text_over_several_lines(make_docs):
    text = "prose first\n\n" + licenses._GRANT.replace(". ", ".\n").replace(", ", ",\n") + "\n\nprose after"
    row = licenses.scan(make_docs([(1, text)])).collect()[0]
    assert row.license == "MIT" and row.score == 1.0 and row.n_matches == 2  # the paragraph and, with little else, the whole


def commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


def test_ordinary_license_files(make_docs):
    own = dict(licenses.full_texts())
    notice = next(t for n, t in licenses.full_texts() if n == "Apache-2.0" and len(t) < 1000)
    code = "import os\n\n\ndef run(a, b):\n    return a + b  # sum of both\n\n\n" * 20
    texts = [("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, A. Person\n\n" + own["BSD-2-Clause"] + "\n" + code),
             ("Apache-2.0", "#!/usr/bin/env python\n# Copyright 2020 Example Inc.\n#\n" + commented(notice, "#") + "\n" + code),
             ("MIT", "/*\n * Copyright (c) 2020 A. Person\n *\n" + commented(own["MIT"], " *") + "\n */\n\n" + code),
             ("Apache-2.0", "See the file of that name for more on it, and ask us. Licensed under the Apache License, Version 2.0."),
             *((name, "Some words before.\n\n" + own[name] + "\n\nSome words after it.") for name in
               ("GPL-2.0", "MPL-2.0", "LGPL-3.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "ISC", "Unlicense")),
             (None, code), (None, "The licence of this software has not been settled, and no permission is granted.")]
    rows = {r.doc_id: r for r in licenses.scan(make_docs([(k, t) for k, (_, t) in enumerate(texts)])).collect()}
    assert [rows[k].license for k in range(len(texts))] == [name for name, _ in texts]
    assert all(r.score > 0.9 for r in rows.values() if r.license and r.doc_id < 3)


def test_two_licenses_in_one_text(make_docs):
    own = dict(licenses.full_texts())
    text = "prose here\n\n" + own["MIT"] + "\n\n" + "more prose about it\n\n" + own["ISC"] + "\nThe pictures: Licensed under CC BY 4.0.\n"
    row = licenses.scan(make_docs([(1, text)])).collect()[0]
    assert set(row.licenses.split(",")) >= {"MIT", "ISC", "CC-BY-4.0"}


def brute_runs(templates, k, words, at):
    """Every start with every end, by counting; overlapping ones by rank."""
    own, b, best_of = templates.counts[k], templates.sizes[k], []
    longest = int(b / templates.ratio + 1e-9)
    for i, s in enumerate(at[:-1]):
        own_first = any(p in own for p in zip(words[s:at[i + 1]], words[s + 1:at[i + 1] + 1]))
        ends = [e for e in at[i + 1:] if e - s - 1 <= longest]
        ranked = [(2 * c / (e - s - 1 + b), c, e) for e in ends
                  for c in [sum((own & Counter(zip(words[s:e], words[s + 1:e]))).values())]]
        if own_first and ranked and max(ranked)[0] >= templates.threshold:
            score, c, e = max(ranked)
            best_of.append((score, c, s, e))
    out = []
    for score, c, s, e in sorted(best_of, key=lambda r: (-r[0], -r[1], r[2])):
        if all(e <= s2 or e2 <= s for _, s2, e2 in out):
            out.append((c, s, e))
    return out


def test_runs_equal_trying_every_start_and_end():
    rng, seen = random.Random(8), 0
    for case in range(300):
        letters = "abcdefgh"[: rng.choice([2, 3, 8])]
        texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(3, 14))) for _ in range(3)]
        templates = licenses.Templates(tuple((f"L{i}", t) for i, t in enumerate(texts)), threshold=rng.choice([0.6, 0.8]))
        words = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice(texts).split()
            words += [rng.choice(letters) for _ in range(rng.randint(0, 6))]
            words += [rng.choice(letters + "xyz") if rng.random() < 0.1 else w for w in own]
        words = [w.encode() for w in words]
        at = sorted({0, len(words), *rng.sample(range(len(words)), min(len(words), rng.randint(0, 12)))})
        pairs = templates.numbered(words)
        for k in range(len(templates.sizes)):
            got, want = templates.runs(k, pairs, at), brute_runs(templates, k, words, at)
            # Of equal rank either may stand for the others; the best are the same.
            assert bool(got) == bool(want)
            score = lambda r: 2 * r[0] / (r[2] - r[1] - 1 + templates.sizes[k])
            if want:
                assert score(got[0]) == score(want[0])
            for c, s, e in got:
                assert c == sum((templates.counts[k] & Counter(zip(words[s:e], words[s + 1:e]))).values())
                assert score((c, s, e)) >= templates.threshold
            assert all(a[2] <= b[1] or b[2] <= a[1] for i, a in enumerate(got) for b in got[:i])
            seen += got == want and bool(want)
    assert seen > 200


def test_many_licenses_in_one_text_take_linear_time():
    import time
    templates = licenses.Templates((*licenses.TEMPLATES, *licenses.full_texts()))
    own = dict(licenses.full_texts())
    times = []
    for n in (2, 8):
        text = "\n\n---\n\n".join(f"Package {i}\n{own['GPL-3.0']}\n{own['MIT']}\n{own['Apache-2.0']}" for i in range(n))
        start = time.process_time()
        found = templates.found(text)
        times.append(time.process_time() - start)
        assert {"GPL-3.0", "MIT", "Apache-2.0"} <= {name for m in found for _, name in m}
    assert times[1] < 12 * times[0] + 1
