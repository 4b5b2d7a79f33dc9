"""DuckDB SQL for the correctness oracle.

These builders write plain SQL text over the pre-registered views
(``documents``, ``labels``, ...).  They restate each operator's semantics
in SQL (RE2 regexes, list lambdas), independently of the Spark code path.
"""

from __future__ import annotations

from ..functions.text import EMAIL_RE, EMOJI_RE, LEADING_WS_RE, MENTION_RE, NOT_KEPT_RE, TRAILING_WS_RE, URL_RE
from ..params import (
    DEFAULT_FUSION, DEFAULT_LEXICON, FALLBACK_PROBS, LABELS, REASON_AMPLIFIED, REASON_BIAS, REASON_HIGH_TERMS,
    REASON_NO_MODEL, REASON_REVIEW, REASON_TERMS, RISK_WEIGHTS, SENSITIVE_CATEGORIES, FusionParams, Lexicon,
)
from .corpus import FIXTURE_PROBS, NO_SCORE_MODULUS, SEED_PHRASES


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def qlist(values) -> str:
    return "([" + ", ".join(q(v) for v in values) + "]::VARCHAR[])"


def dlist(values) -> str:
    return "[" + ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in values) + "]"


def corpus_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN {q(p)}" for i, p in enumerate(SEED_PHRASES))
    return (f"SELECT doc_id, text || ' ' || (CASE doc_id % 16 {cases} END) AS text, lang, source "
            f"FROM documents")


def probs_by_bucket_sql(k: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {dlist(row)}" for i, row in enumerate(FIXTURE_PROBS))
    return f"(CASE {k} {cases} END)"


def fixture_probs_sql(key: str = "doc_id") -> str:
    return f"(CASE WHEN {key} % {NO_SCORE_MODULUS} = 0 THEN NULL ELSE {probs_by_bucket_sql(f'{key} % 5')} END)"


def ustrip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q(LEADING_WS_RE)}, ''), {q(TRAILING_WS_RE)}, '')"


def clean_sql(x: str) -> str:
    low = f"lower({x})"
    scrub = low
    for pat in (EMOJI_RE, URL_RE, MENTION_RE, EMAIL_RE):
        scrub = f"regexp_replace({scrub}, {q(pat)}, ' ', 'g')"
    mid = f"(CASE WHEN contains({low}, '@') OR contains({low}, '://') THEN {scrub} ELSE {low} END)"
    return f"trim(regexp_replace({mid}, {q(NOT_KEPT_RE)}, ' ', 'g'))"


def tokens_sql(cleaned: str) -> str:
    return f"(CASE WHEN {cleaned} = '' THEN []::VARCHAR[] ELSE string_split({cleaned}, ' ') END)"


def _word_re(term: str) -> str:
    from ..operators.rules import word_regex
    return word_regex(term)


def rules_select_sql(cleaned: str = "cleaned", lexicon: Lexicon = DEFAULT_LEXICON) -> str:
    """Select-list items: per severity ``kw_<i>``, ``pat_terms``,
    ``pat_cats``; all keyword tests restated as membership / regex."""
    import re
    items = []
    toks = f"string_split_regex({cleaned}, '['' ]')"
    for i, (sev, terms) in enumerate(lexicon.keywords):
        tests = []
        for t in terms:
            if re.fullmatch(r"[a-z0-9]+", t.lower()):
                tests.append(f"CASE WHEN list_contains({toks}, {q(t.lower())}) THEN {q(t.lower())} END")
            else:
                tests.append(f"CASE WHEN regexp_matches({cleaned}, {q(_word_re(t))}) THEN {q(t.lower())} END")
        items.append(f"list_filter([{', '.join(tests)}]::VARCHAR[], lambda x: x IS NOT NULL) AS kw_{i}")
    pats = []
    cats = []
    for cat, ps in lexicon.patterns:
        for p in ps:
            pats.append(f"CASE WHEN contains({cleaned}, {q(p.lower())}) THEN {q(p)} END")
            cats.append(f"CASE WHEN contains({cleaned}, {q(p.lower())}) THEN {q(cat)} END")
    items.append(f"list_filter([{', '.join(pats)}]::VARCHAR[], lambda x: x IS NOT NULL) AS pat_terms")
    items.append(f"list_filter([{', '.join(cats)}]::VARCHAR[], lambda x: x IS NOT NULL) AS pat_cats")
    return ",\n  ".join(items)


def rule_derived_sql(lexicon: Lexicon = DEFAULT_LEXICON) -> str:
    n = len(lexicon.keywords)
    kw_hits = " || ".join(f"kw_{i}" for i in range(n)) if n else "[]::VARCHAR[]"
    points = " + ".join(f"len(kw_{i}) * {lexicon.weight(s)}" for i, (s, _) in enumerate(lexicon.keywords)) or "0"
    hi = [i for i, (s, _) in enumerate(lexicon.keywords) if s == lexicon.high_group]
    high = f"kw_{hi[0]}" if hi else "[]::VARCHAR[]"
    return (f"({kw_hits}) AS kw_hits, CAST({points} AS INTEGER) AS kw_points, {high} AS high_terms, "
            f"CAST(len(pat_terms) AS INTEGER) AS pattern_count, ({kw_hits}) || pat_terms AS rule_terms, "
            f"CAST(least({points} + len(pat_terms) * {lexicon.pattern_weight}, 100) AS INTEGER) AS rule_risk, "
            f"(len({kw_hits}) > 0 OR len(pat_terms) > 0) AS rule_flagged, (len({high}) > 0) AS has_high_risk")


def ml_select_sql(probs: str = "probs") -> str:
    fb = dlist(FALLBACK_PROBS)
    return f"({probs} IS NULL) AS ml_missing, coalesce({probs}, {fb}) AS ml_probs"


def ml_derived_sql() -> str:
    labels = qlist(LABELS)
    return ("CAST(list_position(ml_probs, list_max(ml_probs)) - 1 AS INTEGER) AS ml_label_id, "
            f"{labels}[list_position(ml_probs, list_max(ml_probs))] AS ml_label, list_max(ml_probs) AS ml_confidence")


def fusion_sql(params: FusionParams = DEFAULT_FUSION) -> tuple[str, str, str]:
    """Three select-list layers: (risk, confidence, bias), (label, review),
    (reasoning)."""
    p = params.normalised()
    wr, wm = float(p.rule_weight), float(p.ml_weight)
    d = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    rule_score = (f"(CASE WHEN has_high_risk THEN (CAST(rule_risk AS DOUBLE) / {d(100)}) * {d(p.amplification)} "
                  f"ELSE CAST(rule_risk AS DOUBLE) / {d(100)} END)")
    mlr = " + ".join(f"ml_probs[{i + 1}] * {d(w)}" for i, w in enumerate(RISK_WEIGHTS))
    fused = f"({d(wr)} * {rule_score} + {d(wm)} * ({mlr}))"
    risk = f"CAST(least(trunc({fused} * {d(100)}), 100) AS INTEGER)"
    base = f"({d(wm)} * ml_confidence + {d(wr)} * (CASE WHEN rule_flagged THEN {d(1)} ELSE {d(0)} END))"
    base = f"(CASE WHEN has_high_risk THEN least({base} * {d(p.confidence_boost)}, {d(1)}) ELSE {base} END)"
    conf = f"floor({base} * {d(100)} + {d(0.5)}) / {d(100)}"
    facs = []
    for cat, words in SENSITIVE_CATEGORIES:
        facs.append(f"{{'category': {q(cat)}, 'terms': list_filter(rule_terms, lambda t: list_contains({qlist(words)}, lower(t)))}}")
    factors = f"list_filter([{', '.join(facs)}], lambda f: len(f.terms) > 0)"
    layer1 = f"{risk} AS risk_score, {conf} AS confidence, {factors} AS risk_factors"

    c1, c2, c3 = p.cutpoints
    label = (f"CASE WHEN risk_score < {c1} THEN {q(LABELS[0])} WHEN risk_score < {c2} THEN {q(LABELS[1])} "
             f"WHEN risk_score < {c3} THEN {q(LABELS[2])} ELSE {q(LABELS[3])} END")
    band = " OR ".join(f"(risk_score >= {lo} AND risk_score <= {hi})" for lo, hi in p.review_bands)
    reasons = (f"list_filter([CASE WHEN confidence < {d(p.review_confidence)} THEN 'low_confidence' END, "
               f"CASE WHEN has_high_risk AND ml_label = {q(LABELS[0])} THEN 'rule_model_disagreement' END, "
               f"CASE WHEN len(risk_factors) > 0 AND risk_score >= {p.bias_review_min_risk} THEN 'bias_risk' END, "
               f"CASE WHEN {band} THEN 'borderline' END]::VARCHAR[], lambda x: x IS NOT NULL)")
    layer2 = (f"{label} AS label, {reasons} AS review_reasons, (len(risk_factors) > 0) AS high_bias_risk, "
              f"list_transform(risk_factors, lambda f: f.category) AS detected_categories")

    pct = "CAST(CAST(round_even(ml_confidence * CAST(100.0 AS DOUBLE), 0) AS INTEGER) AS VARCHAR)"
    reasoning = ("concat_ws('; ', "
                 f"CASE WHEN len(rule_terms) > 0 THEN (CASE WHEN len(high_terms) > 0 THEN {q(REASON_HIGH_TERMS)} || "
                 f"array_to_string(high_terms[1:3], ', ') ELSE {q(REASON_TERMS)} || array_to_string(rule_terms[1:3], ', ') END) END, "
                 f"'ML model classified as ''' || ml_label || ''' with ' || {pct} || '% confidence', "
                 f"CASE WHEN has_high_risk THEN {q(REASON_AMPLIFIED)} END, "
                 f"CASE WHEN high_bias_risk THEN {q(REASON_BIAS)} END, "
                 f"CASE WHEN len(review_reasons) > 0 THEN {q(REASON_REVIEW)} END)")
    reasoning = f"CASE WHEN ml_missing THEN {reasoning} || {q(REASON_NO_MODEL)} ELSE {reasoning} END"
    layer3 = f"{reasoning} AS reasoning, (len(review_reasons) > 0) AS requires_human_review"
    return layer1, layer2, layer3


def classified_ctes(source_sql: str | None = None, params: FusionParams = DEFAULT_FUSION, max_chars: int | None = None,
                    probs_sql: str | None = None, key: str = "doc_id") -> str:
    """CTE chain ending in ``fused3``: the full classification per row."""
    src = source_sql or corpus_sql()
    probs = probs_sql or fixture_probs_sql(key)
    l1, l2, l3 = fusion_sql(params)
    cut_sql = (f"substring(text, 1, {max_chars}) AS input, length(text) > {max_chars} AS was_truncated" if max_chars
               else "text AS input, false AS was_truncated")
    return f"""
src AS ({src}),
cut AS (SELECT *, {cut_sql} FROM src),
cl AS (SELECT *, {clean_sql('input')} AS cleaned FROM cut),
ru AS (SELECT *, {rules_select_sql('cleaned')} FROM cl),
ru2 AS (SELECT *, {rule_derived_sql()} FROM ru),
ml AS (SELECT *, {ml_select_sql(probs)} FROM ru2),
ml2 AS (SELECT *, {ml_derived_sql()} FROM ml),
fused1 AS (SELECT *, {l1} FROM ml2),
fused2 AS (SELECT *, {l2} FROM fused1),
fused3 AS (SELECT *, {l3} FROM fused2)"""


def flat_result_select(key: str = "doc_id") -> str:
    """The flat checked projection of a classification (see
    ``plans.classify.flat_result``)."""
    factors = ("array_to_string(list_transform(risk_factors, lambda f: f.category || '=' || "
               "array_to_string(f.terms, '|')), ';')")
    return (f"{key}, CAST(length(input) AS INTEGER) AS input_chars, was_truncated, label, confidence, risk_score, "
            "array_to_string(rule_terms, ', ') AS flagged_terms, requires_human_review, "
            "high_bias_risk AS bias_risk, array_to_string(detected_categories, ',') AS bias_categories, "
            f"{factors} AS bias_terms, array_to_string(review_reasons, ',') AS review_reasons, reasoning, "
            "has_high_risk AS rule_amplification")
