import hashlib
import itertools
import random
import re
import zlib

import pytest

from riskscope.llm.queries import op13_structure_repair
from riskscope.llm.repair import Plan, damage, digests, faults, repair, repaired_digest

GOOD = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def every_repair(rows):
    """(cost, audit) of all edit sequences with up to two inserts in a gap;
    rows are (initial, must_go, truncated)."""
    gaps = [[]] + [["u"], ["a"], ["u", "a"], ["a", "u"]]
    best = None
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product(("K", "Ru", "Ra", "D"), repeat=len(rows)):
            cost, audit, initials = 3 * len(inserts[0]), "I" * len(inserts[0]), "".join(inserts[0])
            for (initial, must_go, truncated), e, more in zip(rows, edits, inserts[1:]):
                if e != "D" and (must_go or (e == "K" and not initial)):
                    break
                cost += {"K": 0, "D": 4}.get(e, 3) + (3 if truncated and e != "D" else 0) + 3 * len(more)
                audit += e[0] + "I" * len(more)
                initials += {"K": initial, "D": ""}.get(e, e[1:]) + "".join(more)
            else:
                if GOOD.fullmatch(initials) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def tuples(rows):
    """The same by (cost, audit) tuples, back to front."""
    step = {"0": "u", "s": "u", "a": "u", "u": "a"}

    def inserted(after):
        for _ in range(3):
            after = {q: min(v for v in (after.get(q), after.get(step[q]) and (after[step[q]][0] + 3, "I" + after[step[q]][1])) if v)
                     for q in step}
        return after

    after = {"0": (0, ""), "a": (0, ""), "s": None, "u": None}
    after = {"0": (0, ""), "a": (0, ""), "u": (3, "I"), "s": (6, "II")}
    for initial, must_go, truncated in reversed(rows):
        extra = 3 if truncated else 0
        now = {}
        for q in step:
            options = [(after[q][0] + 4, "D" + after[q][1])]
            if not must_go:
                if initial == step[q] or (initial == "s" and q == "0"):
                    options.append((after[initial][0] + extra, "K" + after[initial][1]))
                options.append((after[step[q]][0] + 3 + extra, "R" + after[step[q]][1]))
            now[q] = min(options)
        after = inserted(now)
    return after["0"]


def planned(rows):
    plan = Plan()
    for r in rows:
        plan.row(*r)
    return plan.best()


KINDS = [("s", False, False), ("u", False, False), ("a", False, False), ("t", False, False), ("", False, False),
         ("u", True, False), ("a", False, True), ("s", False, True), ("u", False, True)]


def test_least_audit_of_all_edit_sequences():
    for rows in itertools.chain([()], itertools.product(KINDS, repeat=1), itertools.product(KINDS, repeat=2)):
        assert planned(rows) == every_repair(rows) == tuples(rows)


@pytest.mark.parametrize("n", [3, 7, 30, 400])
def test_long_conversations_keep_the_order_of_ties(n):
    """Digits start afresh every sixty letters: the result is that of tuples."""
    rng = random.Random(n)
    for _ in range(300 if n < 100 else 20):
        kinds = rng.choices(KINDS, k=rng.randint(1, 5))
        rows = [rng.choice(kinds) for _ in range(n)]
        assert planned(rows) == tuples(rows)


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else v
        hit = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [] if hit == 0 else [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def expected(rows, after):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marks, seen = [], set()
        for _, _, role, text in mine:
            said = BLANK.findall(text)
            marks.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {r[1] for r in mine if r[1] is not None}
        plan = [(r[2][:1], m in ("blank", "duplicate"), m == "truncated") for r, m in zip(mine, marks)]
        cost, audit = tuples(plan)
        lines, state, at = [], "0", 0
        for letter in audit:
            if letter == "I":
                state = "a" if state == "u" else "u"
                lines.append({"u": "user:", "a": "assistant:"}[state])
                continue
            _, _, role, text = mine[at]
            at += 1
            if letter == "K":
                state = role[0]
                lines.append(f"{role}:{text}")
            elif letter == "R":
                state = "a" if state == "u" else "u"
                lines.append({"u": "user:", "a": "assistant:"}[state] + text)
        assert at == len(mine)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(k) for k in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", False) for r in rows],
                                 "conv_id long, turn long, role string, text string, gone int, fault string, audit boolean")


def test_odd_rows_equal_brute_force(spark):
    rng = random.Random(4)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "umpire"]
    texts = ["Yes.", "No", "Why? ", " \t", "", None, "é!\n", "…", "a.\x0b", "x "]
    rows = [(c if c else None, rng.choice([None, *range(12)]) if c % 3 == 0 else t, rng.choice(roles if c % 2 else roles[:3]), rng.choice(texts))
            for c in range(60) for t in range(rng.randint(1, 14))]
    rows += [(900, 0, "user", "Hi.")] * 5 + [(901, 5, "user", "x" * 50000), (902, None, None, None)]
    rows += [(903, t, ("user", "assistant")[t % 2], f"said {t % 40}.") for t in range(700)]
    got = sorted(map(tuple, repaired_digest(damage(frame(spark, rows).repartition(7))).collect()), key=repr)
    assert got == expected(rows, broken(rows))
    assert repaired_digest(damage(frame(spark, []))).collect() == []


def test_dropped_conversation_keeps_its_row(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repaired_digest(damage(frame(spark, [(conv, 0, "user", "Hi.")]))).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repaired_turns(spark):
    rows = damage(frame(spark, [(1, t, "user", f"Text {t}.") for t in range(40)]))
    reports, turns = repair(rows)
    said = turns.orderBy("turn_no").collect()
    assert [r.turn_no for r in said] == list(range(len(said)))
    assert GOOD.fullmatch("".join(r.role[0] for r in said))
    assert "".join(r.edit for r in said) == reports.first().audit.replace("D", "")
    assert digests(turns).first().repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in said).encode()).hexdigest()
    assert faults(rows).where("fault = 'duplicate'").count() == 0


def test_query_equals_brute_force(spark, small_sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, op13_structure_repair(spark, small_sf).collect()), key=repr)
    assert got == expected(rows, broken(rows))
