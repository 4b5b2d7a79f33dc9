"""An independent row-at-a-time model of the classification, used as a
Python (char predicates, token tests, lookaround regexes); it is not used by
the library."""

from __future__ import annotations

import bisect
import math
import re

from riskscope.params import (
    FALLBACK_PROBS, KEYWORDS, LABELS, PATTERNS, RISK_WEIGHTS, SENSITIVE_CATEGORIES, SEVERITY_WEIGHTS,
)

# FIXED VALUES: symbol ranges removed before the link rules (code points)
_SYMBOL_RANGES = ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF),
                  (0x2702, 0x27B0), (0x24C2, 0x1F251))
_KEPT = set("abcdefghijklmnopqrstuvwxyz0123456789'")


def _is_symbol(ch: str) -> bool:
    o = ord(ch)
    return any(lo <= o <= hi for lo, hi in _SYMBOL_RANGES)


def _strip_symbols(t: str) -> str:
    return re.sub(r"￿+", " ", "".join("￿" if _is_symbol(c) else c for c in t))


def clean(text: str) -> str:
    t = _strip_symbols(text.lower())
    t = re.sub(r"https?://[!$-_a-z]+", " ", t)          # '$-_' is the range U+0024..U+005F
    t = re.sub(r"@\w+", " ", t)                          # Unicode word characters
    kept = []
    for tok in t.split():                                # e-mail: a whole whitespace token
        at = tok.find("@", 1)                            # an '@' after the first character,
        if at > 0 and tok.find(".", at + 2, len(tok) - 1) != -1:   # then '.', both with text around
            continue
        kept.append(tok)
    out = "".join(c if c in _KEPT else " " for c in " ".join(kept))
    return " ".join(out.split())


def _word_hit(cleaned: str, term: str) -> bool:
    return re.search(r"(?<![a-z0-9])" + re.escape(term) + r"(?![a-z0-9])", cleaned) is not None


def analyze(cleaned: str) -> dict:
    by_sev = {sev: [k for k in kws if _word_hit(cleaned, k)] for sev, kws in KEYWORDS}
    kw_terms = [k for sev, _ in KEYWORDS for k in by_sev[sev]]
    pats = [p for _, ps in PATTERNS for p in ps if p in cleaned]
    points = sum(len(v) * SEVERITY_WEIGHTS.get(s, 1) for s, v in by_sev.items())
    return {"flagged": bool(kw_terms or pats), "terms": kw_terms + pats,
            "risk": min(points + 2 * len(pats), 100), "high": by_sev["high_risk"]}


_REASONS = (
    ("low_confidence", lambda r: r["confidence"] < 0.7),
    ("rule_model_disagreement", lambda r: r["high"] and r["ml_label"] == LABELS[0]),
    ("bias_risk", lambda r: r["bias"] and r["risk_score"] >= 25),
    ("borderline", lambda r: any(lo <= r["risk_score"] <= hi for lo, hi in ((20, 30), (45, 55), (70, 80)))),
)


def fuse(rule: dict, probs, cut=(25, 50, 75)) -> dict:
    p = list(FALLBACK_PROBS if probs is None else probs)
    top = max(p)
    ml_label = LABELS[p.index(top)]
    amp = 1.5 if rule["high"] else 1.0
    ml_part = 0.0
    for pi, wi in zip(p, RISK_WEIGHTS):
        ml_part += pi * wi
    risk = min(int((0.3 * (rule["risk"] / 100.0 * amp) + 0.7 * ml_part) * 100), 100)
    conf = 0.7 * top + 0.3 * (1.0 if rule["flagged"] else 0.0)
    if rule["high"]:
        conf = min(conf * 1.2, 1.0)
    conf = math.floor(conf * 100 + 0.5) / 100
    factors = [(c, [t for t in rule["terms"] if t.lower() in ws]) for c, ws in SENSITIVE_CATEGORIES]
    factors = [(c, f) for c, f in factors if f]
    row = {"confidence": conf, "high": rule["high"], "ml_label": ml_label, "bias": bool(factors), "risk_score": risk}
    reasons = [name for name, test in _REASONS if test(row)]
    shown = rule["high"][:3] if rule["high"] else rule["terms"][:3]
    parts = [("High-risk terms detected: " if rule["high"] else "Flagged keywords found: ") + ", ".join(shown)
             ] if rule["terms"] else []
    parts.append(f"ML model classified as '{ml_label}' with {round(top * 100)}% confidence")
    parts += [s for s, on in (("Rule engine applied amplification due to high-risk content", rule["high"]),
                              ("Potential context-sensitive bias detected (sensitive categories)", factors),
                              ("Flagged for human review due to ambiguity or potential bias", reasons)) if on]
    note = " (ML model unavailable: no model score for this row)" if probs is None else ""
    return {
        "label": LABELS[bisect.bisect_right(list(cut), risk)], "risk_score": risk, "confidence": conf,
        "flagged_terms": ", ".join(rule["terms"]), "requires_human_review": bool(reasons),
        "bias_categories": ",".join(c for c, _ in factors),
        "bias_terms": ";".join(c + "=" + "|".join(f) for c, f in factors),
        "review_reasons": ",".join(reasons), "reasoning": "; ".join(parts) + note,
        "rule_amplification": bool(rule["high"]),
    }
