import hashlib
import math
import random
import re

from riskscope.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(odd[::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in odd[1::2]) % 10


def brute(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text)
            if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_on_random_strings():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("ab1234567890.@@-+ ()_é\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("a@b@c.com x@y.z@w.com @a.b a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 00255.0.0.1 1..2.3.4", "4111 1111-1111 1111 x 4111111111111112",
                 "+1 (017) 555-7713 +12 +1234567 +1 23456789012345678", "a" * 5000 + "@" + "b" * 5000 + ".c", "9" * 20000):
        assert pii.base_spans(text) == brute(text)


def test_cells_and_reliabilities():
    cell = pii._cell("secret", [2, 0, 1, 2, 0], 3)
    assert pii._decode(cell) == (2, [2, 0, 1, 2, 0], 3)
    good, bad = pii._cell("phone", [2, 2, 2, 2, 2], 3), pii._cell("phone", [0, 0, 1, 1, 1], 0)
    silent = pii._cell("phone", [0, 0, 0, 0, 0], 1)
    taken = pii.fit({good: 500, bad: 400, silent: 50, pii._cell("phone", [0, 2, 2, 2, 2], 3): 60})
    assert good in taken and bad not in taken and silent not in taken
    assert pii.fit({}) == frozenset()


def brute_fit(rows):
    """Candidate by candidate: expectation-maximisation over (votes, bucket) rows,
    then the classifier by accelerated gradient steps instead of Newton's."""
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-30, min(30, z))))
    post = [sigmoid(1.2 * v.count(2) - 1.2 * v.count(1) - 1.5) for v, _ in rows]
    for _ in range(60):
        right_true, right_false = [], []
        for k in range(5):
            spoke = [(v[k], p) for (v, _), p in zip(rows, post) if v[k]]
            right_true.append((sum(p for x, p in spoke if x == 2) + 6) / (sum(p for _, p in spoke) + 8))
            right_false.append((sum(1 - p for x, p in spoke if x == 1) + 6) / (sum(1 - p for _, p in spoke) + 8))
        prior = (sum(post) + 1) / (len(rows) + 2)
        new = []
        for v, _ in rows:
            yes, no = prior, 1 - prior
            for k in range(5):
                yes *= {0: 1, 1: 1 - right_true[k], 2: right_true[k]}[v[k]]
                no *= {0: 1, 1: right_false[k], 2: 1 - right_false[k]}[v[k]]
            new.append(sigmoid(math.log(yes / no)))
        post = new
    features = [[1.0, *(x == 2 for x in v), *(x == 1 for x in v), *(b == i for i in range(4))] for v, b in rows]
    w = ahead = [0.0] * 15
    for step in range(1500):
        slope = [1e-3 * a for a in ahead]
        for x, p in zip(features, post):
            off = (sigmoid(sum(a * b for a, b in zip(ahead, x))) - p) / len(rows)
            slope = [g + off * b for g, b in zip(slope, x)]
        last, w = w, [a - g / 2.0 for a, g in zip(ahead, slope)]
        ahead = [b + 0.95 * (b - a) for a, b in zip(last, w)]
    return [sum(a * b for a, b in zip(w, x)) for x in features]


def test_fit_equals_candidate_by_candidate():
    rng = random.Random(8)
    for kind in ("phone", "email", "secret"):
        cells, rows = {}, []
        for _ in range(14):
            true = rng.random() < 0.5
            votes = [rng.choice([0, 2, 2, 2, 1] if true else [0, 1, 1, 1, 2]) for _ in range(5)]
            bucket, n = rng.randrange(4), rng.randint(1, 5)
            cells[pii._cell(kind, votes, bucket)] = n
        for cell, n in cells.items():
            rows += [(pii._decode(cell)[1], pii._decode(cell)[2])] * n
        taken, bound = pii.fit(cells), math.log(pii.ACCEPT / (1 - pii.ACCEPT))
        for (votes, bucket), z in zip(rows, brute_fit(rows)):
            if abs(z - bound) > 1e-2:
                assert (pii._cell(kind, votes, bucket) in taken) == (z > bound and 2 in votes)


def rows_of(make_docs, pairs):
    return pii.personal_data(make_docs(pairs)).collect()


def test_query_on_odd_and_real_rows(spark, make_docs, odd_texts, small_sf):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()]
    extra = [(900, 'call 017 555-7713 or mail me: jo(at)site.com, password = "hunter2hunter2XY99" ok'),
             (901, "order 2024-01-02 no. 1234567890123 at 10.0.0.300"), (902, "jo@site.com")]
    for pairs in (odd_texts, real + extra, []):
        got = rows_of(make_docs, pairs)
        want = []
        for i, t in pairs:
            b = brute(t or "")
            n = [sum(k == kind for k, _, _ in b) for kind in pii.BASE_KINDS]
            want.append((i, *n, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()))
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
        texts = dict(pairs)
        for r in got:
            spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
            assert set(brute(texts[r.doc_id] or "")) <= set(spans)
            assert spans == sorted(spans, key=lambda x: (pii.KIND_ORDER.index(x[0]), x[1]))
            flat = sorted((s, e) for k, s, e in spans if (k, s, e) not in brute(texts[r.doc_id] or ""))
            assert all(a[1] <= b[0] for a, b in zip(flat, flat[1:]))
            if r.doc_id == 901:
                assert r.spans == ""


def test_redaction_keeps_columns(make_docs):
    docs = make_docs([(1, "write to jo@site.com now"), (2, None), (3, "clean words"), (4, "")])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("write to <EMAIL> now", 20), 2: (None, None), 3: ("clean words", 11), 4: ("", 0)}


LONG = "eyJhbGciOiJIUzI1NiJ9." + "aZ09_-xQ7b" * 40
SECRETS = [(f'token = "{LONG}"', LONG), (f"token={LONG} and more", LONG), ("access_token=9f86d081884c7d659a2f", "9f86d081884c7d659a2f"),
           ("client_secret: 'Zx81-kk20.Qm37_aa'", "Zx81-kk20.Qm37_aa"), ("export DB_PASSWORD=hunter2hunter2XY99", "hunter2hunter2XY99"),
           ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG+bPxRfiCYEX", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEX"),
           ('{"token": "9f86d081884c7d659a2f", "n": 1}', "9f86d081884c7d659a2f"), ('{"accessToken":"9f86d081884c7d659a2f"}', "9f86d081884c7d659a2f"),
           ('{\\"api_key\\": \\"9f86d081884c7d659a2f\\"}', "9f86d081884c7d659a2f"), ("auth.token: YWJjZGVmZ2hpamts12==", "YWJjZGVmZ2hpamts12=="),
           ('password="hunter2hunter2!XY$99"', "hunter2hunter2!XY$99")]


def test_secrets_are_proposed_whole():
    for text, value in SECRETS:
        found = [text[s:e] for kind, s, e, _ in pii.candidates(text, pii.base_spans(text)) if kind == "secret"]
        assert found == [value], text
    for text in ("monkey=9f86d081884c7d659a2f", "keyboard: mechanical-one", "tokens=9f86d081884c7d659a2f", "a token of esteem"):
        assert not [c for c in pii.candidates(text, []) if c[0] == "secret"], text


def test_redaction_leaves_no_rest_of_a_secret(make_docs):
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    pairs = [(k, f'config: token = "{h}" end') for k, h in enumerate(hexes)]
    pairs += [(100, f'config: token = "{LONG}" end'), (101, f'config: client_secret = "{hexes[0]}" end'),
              (102, f'config: {{"token": "{hexes[1]}"}} end')]
    got = {r.doc_id: r.text for r in pii.redact(make_docs(pairs)).collect()}
    assert got[0] == 'config: token = "<SECRET>" end'
    assert got[100] == got[0]
    assert got[101] == 'config: client_secret = "<SECRET>" end'
    assert got[102] == 'config: {"token": "<SECRET>"} end'
