"""Personal data (operator 8): weak supervision.

Base spans come from fixed patterns with validation (e-mail, ip, card, phone).
Looser candidates (phone numbers without a plus, disguised e-mail addresses,
secrets) are put before five labelers that vote for, against, or abstain:
strict pattern, gazetteer, context words, shape, and size.  Votes and a few
features make a cell; the counts of all candidates by cell (a table whose size
the code bounds, whatever the input) feed expectation-maximisation, which
estimates each labeler's reliability without labels.  A logistic span
classifier is trained on the posteriors, weighted by the counts, and decides
each cell.  Accepted candidates that do not overlap a base span are added.

Nulls and empty texts have no spans.  Offsets are code points, ends exclusive.
Repeated rows and ties give a row each.  With no candidates at all nothing is
trained and only base spans remain; an empty table gives an empty result.
Other columns are ignored, or kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import keyed_text, pieces, stored

BASE_KINDS = ("email", "ip", "card", "phone")       # fixed: the order of the contract
ADDED_KINDS = ("phone", "email", "secret")          # kinds of candidates
KIND_ORDER = (*BASE_KINDS, "secret")
LABELERS = ("strict", "gazetteer", "context", "shape", "size")
ACCEPT = 0.8

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that starts inside a run of digits would also start at the run, so
# the look-behind changes nothing but the cost.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LOOSE_PHONE = re.compile(r"(?<![\w.+])[+(]?[0-9][0-9 ().-]{5,22}[0-9](?!\w)")
_DISGUISED = re.compile(r"\((?:at|AT)\)|\[(?:at|AT)\]| @ ")
_DOMAIN_LOOSE = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,24}){1,4}")
# The name may follow a prefix (client_secret, db.password, accessToken) and be
# quoted.  The value runs to its end, in quotes up to the closing one.
_SECRET = re.compile(r"(?:(?<![^\W_])|(?-i:(?<=[a-z])(?=[A-Z])))(?P<name>token|secret|password|passwd|pwd|api[_-]?key|key)\b"
                     r"(?:\\?[\"'])?[ \t]{0,3}[=:][ \t]{0,3}(?:\\?(?P<quote>[\"']))?"
                     r"(?P<value>[A-Za-z0-9_+/.~-]{8,}+(?(quote)[^\s\"'\\]*+|={0,2}))", re.I)

# Gazetteers and context words: fixed values.
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
            "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82",
            "84", "86", "90", "91", "92", "93", "94", "95", "98")
_TLDS = frozenset("com org net edu gov io info biz co us uk de fr es it nl eu ch at be se no dk fi pl ru cn jp in br au ca".split())
_SECRET_NAMES = frozenset(("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey"))
_FOR = {
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|tél|téléphone|teléfono)\b", re.I),
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|correo|courriel)\b", re.I),
    "secret": re.compile(r"\b(?:auth|bearer|credentials?|login|config|export)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:order|invoice|isbn|issn|page|version|line|date|serial|no|nr|id|doi|vol|section)\b[.:# ]*$", re.I)
_DATE = re.compile(r"\d{4}[-. ]\d{1,2}[-. ]\d{1,2}|\d{1,2}[-. ]\d{1,2}[-. ]\d{4}")
_GROUPED = re.compile(r"(?:\+?\d{1,3}[ .-])?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches, found from each @ outwards (a scan
    from every start would be quadratic on long words)."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if at >= done and start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _votes(kind: str, span: str, before: str, strict: bool, name: str = "") -> tuple[list[int], int]:
    """Each labeler's vote (0 abstains, 1 against, 2 for) and a feature bucket."""
    context = 2 if _FOR[kind].search(before) else 1 if _AGAINST.search(before) else 0
    if kind == "phone":
        digits = re.sub(r"\D", "", span)
        gaz = 2 if span[0] == "+" and digits.startswith(_CALLING) else 0
        shape = 1 if _DATE.fullmatch(span) or digits == span else 2 if _GROUPED.fullmatch(span) else 0
        size = 2 if 10 <= len(digits) <= 13 else 1 if len(digits) < 7 or len(digits) > 15 else 0
        bucket = min(3, len(re.findall(r"\D+", span)))
    elif kind == "email":
        tld = re.split(r"[.\s)\]]+", span)[-1].lower()
        gaz = 2 if tld in _TLDS else 1
        shape = 2 if span[0].isalnum() and re.search("[A-Za-z]", span.split(" ")[0]) else 1
        size = 2 if 6 <= len(span) <= 80 else 1
        bucket = min(3, span.count(" "))
    else:
        gaz = 2 if name.lower() in _SECRET_NAMES else 0
        shape = 2 if _entropy(span) >= 3 and _DIGIT.search(span) else 1
        size = 2 if len(span) >= 20 else 1 if len(span) < 12 else 0
        bucket = min(3, len(span) // 16)
    return [2 if strict else 0, gaz, context, shape, size], bucket


def _cell(kind: str, votes: list[int], bucket: int) -> int:
    code = ADDED_KINDS.index(kind)
    for v in votes:
        code = code * 3 + v
    return code * 4 + bucket


def _decode(cell: int) -> tuple[int, list[int], int]:
    cell, bucket = divmod(cell, 4)
    votes = []
    for _ in LABELERS:
        cell, v = divmod(cell, 3)
        votes.append(v)
    return cell, votes[::-1], bucket


def _merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _overlaps(merged: tuple[list[int], list[int]], s: int, e: int) -> bool:
    """Whether [s, e) meets one of the spans."""
    starts, ends = merged
    k = bisect_right(ends, s)
    return k < len(starts) and starts[k] < e


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, cell) of the loose candidates.  Those that are base
    spans show the labelers what strict matches look like; those that overlap a
    base span of another kind are explained by it."""
    found: list[tuple[str, int, int, str]] = []
    if _DIGIT.search(text):
        found += [("phone", m.start(), m.end(), "") for m in _LOOSE_PHONE.finditer(text)
                  if 7 <= sum(c.isdigit() for c in m[0]) <= 15]
    if "(" in text or "[" in text or " @ " in text:
        for m in _DISGUISED.finditer(text):
            start = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
            end = start
            while start > 0 and end - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            d = _DOMAIN_LOOSE.match(text, m.end())
            if d and start < end:
                found.append(("email", start, d.end(), ""))
    found += [("email", s, e, "") for k, s, e in base if k == "email"]
    if "=" in text or ":" in text:
        found += [("secret", *m.span("value"), m["name"]) for m in _SECRET.finditer(text)]
    out = []
    spans = set(base)
    others = {kind: _merged((s, e) for k, s, e in base if k != kind) for kind in {f[0] for f in found}}
    for kind, s, e, name in found:
        if _overlaps(others[kind], s, e):
            continue
        strict = (kind, s, e) in spans or bool(name) and text[s - 1:s] in "\"'"
        votes, bucket = _votes(kind, text[s:e], text[max(0, s - 32):s], strict, name)
        out.append((kind, s, e, _cell(kind, votes, bucket)))
    return out


def fit(cells: dict[int, int], rounds: int = 60) -> frozenset[int]:
    """The accepted cells: expectation-maximisation over the votes, then a
    logistic classifier on the posteriors."""
    accepted = set()
    for kind in range(len(ADDED_KINDS)):
        own = sorted(c for c in cells if _decode(c)[0] == kind)
        if not own:
            continue
        n = np.array([cells[c] for c in own], float)
        votes = np.array([_decode(c)[1] for c in own])
        buckets = np.array([_decode(c)[2] for c in own])
        pro, con = votes == 2, votes == 1
        post = 1 / (1 + np.exp(-(1.2 * pro.sum(1) - 1.2 * con.sum(1) - 1.5)))
        for _ in range(rounds):
            # Reliability: how often a labeler that votes is right, for true and for
            # false candidates, smoothed towards 0.75.
            hit = ((post * n) @ pro + 6) / ((post * n) @ (pro | con) + 8)
            miss = (((1 - post) * n) @ con + 6) / (((1 - post) * n) @ (pro | con) + 8)
            prior = (post @ n + 1) / (n.sum() + 2)
            odds = math.log(prior / (1 - prior)) + pro @ np.log(hit / (1 - miss)) + con @ np.log((1 - hit) / miss)
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        x = np.hstack([np.ones((len(own), 1)), pro, con, buckets[:, None] == np.arange(4)[None, :]]).astype(float)
        w, weight = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w -= np.linalg.solve(h, x.T @ (weight * (p - post)) + 1e-3 * w)
        # A candidate for which no labeler spoke is never added.
        accepted |= {c for c, z, some in zip(own, x @ w, pro.any(1)) if some and z >= math.log(ACCEPT / (1 - ACCEPT))}
    return frozenset(accepted)


def spans_of(text: str, accepted: frozenset[int]) -> tuple[list, list]:
    """Base spans, and all spans, in order."""
    base = base_spans(text)
    if not accepted:
        return base, base
    return base, _with_added(base, candidates(text, base), accepted)


def _with_added(base, found, accepted):
    taken, added, last = _merged((s, e) for _, s, e in base), [], 0
    for kind, s, e, cell in sorted(found, key=lambda c: (c[1], -c[2])):
        # Added spans stand in order: only the last one can overlap the next.
        if cell in accepted and s >= last and not _overlaps(taken, s, e):
            added.append((kind, s, e))
            last = e
    return sorted([*base, *added], key=lambda x: (KIND_ORDER.index(x[0]), x[1], x[2]))


def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = "doc_id long, base array<struct<kind:string,s:int,e:int>>, found array<struct<kind:string,s:int,e:int,cell:int>>"


def _scan(docs: DataFrame) -> DataFrame:
    span = [("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]
    kinds = (pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("cell", pa.int32())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, 1)):
            base, found = [], []
            for text in batch.column(1).to_pylist():
                b = base_spans(text or "")
                base.append([dict(zip("kind s e".split(), x)) for x in b])
                found.append([dict(zip("kind s e cell".split(), x)) for x in candidates(text or "", b)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kinds[0]), pa.array(found, kinds[1])],
                                             names=["doc_id", "base", "found"])

    return docs.mapInArrow(run, _FOUND)


def _accepted(found: DataFrame) -> frozenset[int]:
    """Cells are at most 3 * 3**5 * 4, so this collects a bounded table."""
    counts = found.select(F.explode("found.cell").alias("cell")).groupBy("cell").count().collect()
    return fit({r["cell"]: r["count"] for r in counts})


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans per document."""
    found = stored(_scan(keyed_text(docs)), "pii")
    accepted = _accepted(found)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS),
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, b, f in zip(*(batch.column(k).to_pylist() for k in range(3))):
                base = [(x["kind"], x["s"], x["e"]) for x in b]
                spans = _with_added(base, [(x["kind"], x["s"], x["e"], x["cell"]) for x in f], accepted)
                n = Counter(k for k, _, _ in base)
                for column, v in zip(out, (doc, *(n[k] for k in BASE_KINDS),
                                           hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                 "base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and the
    length column, if there is one, set to the new text's."""
    accepted = _accepted(_scan(docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text).alias("text"))))

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, at = [], 0
        for kind, s, e in sorted(spans_of(value, accepted)[1], key=lambda x: (x[1], -x[2])):
            if s >= at:
                out += [value[at:s], f"<{kind.upper()}>"]
            at = max(at, e)
        return "".join([*out, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = names.index("text")
        for batch in (p for b in batches for p in pieces(b, k)):
            yield batch.set_column(k, batch.schema.field(k),
                                   pa.array([clean(t) for t in batch.column(k).to_pylist()], batch.schema.field(k).type))

    if text != "text":
        raise ValueError("redact works on the column 'text'")
    names = docs.columns
    out = docs.mapInArrow(run, docs.schema)
    if length in docs.columns:
        out = out.withColumn(length, F.char_length("text").cast(docs.schema[length].dataType))
    return out
