"""Job parameters and the fixed values every result depends on.

Everything here is a plain driver-side literal.  Operators turn these into
Spark literals (arrays, ``CASE`` chains) so that the whole pipeline stays
inside native expressions and whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference behaviour for identical results)
# ---------------------------------------------------------------------------

# Class labels, ids 0..3 in this order.
LABELS: tuple[str, ...] = (
    "Non-Radical",
    "Mildly Radical",
    "Moderately Radical",
    "Highly Radical",
)

# Risk weight per label, same order as LABELS.
RISK_WEIGHTS: tuple[float, ...] = (0.0, 0.33, 0.66, 1.0)

# Lexicon: keywords by severity, patterns by category, weights by severity.
KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("high_risk", (
        "kill", "eliminate", "destroy", "attack", "bomb", "explode", "violence",
        "massacre", "slaughter", "purge", "exterminate", "terror", "extremist",
        "radical", "holy war", "jihad", "martyr", "sacrifice",
    )),
    ("medium_risk", (
        "enemy", "infidel", "disbeliever", "traitor", "collaborator", "corrupt",
        "evil", "wicked", "impure", "righteous", "purification", "us versus them",
        "our people", "blood",
    )),
    ("low_risk", (
        "oppression", "injustice", "struggle", "fight", "resist", "defend",
        "protect", "homeland", "nation", "faith", "belief", "ideology", "freedom",
        "liberation", "rights", "justice",
    )),
)

PATTERNS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("call_to_violence", (
        "by any means necessary", "by all means", "must rise", "rise up",
        "take up arms", "fight back", "we will not rest until", "no quarter",
    )),
    ("recruitment", (
        "join us", "join the cause", "become a soldier", "recruit",
        "brothers and sisters", "come to",
    )),
    ("dehumanization", (
        "less than human", "subhuman", "vermin", "parasites", "cancer", "disease",
        "filth",
    )),
    ("conspiracy", (
        "new world order", "deep state", "illuminati", "globalist", "sheeple",
        "wake up", "they don't want you to know", "hidden agenda",
        "controlled opposition",
    )),
    ("inciteful", (
        "silence is consent", "complicit", "complicity", "if you are not with us",
        "neutrality is violence", "words are not enough",
    )),
)

SEVERITY_WEIGHTS: dict[str, int] = {
    "high_risk": 3,
    "medium_risk": 2,
    "low_risk": 1,
    "conspiracy": 2,
    "inciteful": 2,
}

# Sensitive categories for the bias check, in this order.
SENSITIVE_CATEGORIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("religion", ("jihad", "holy war", "faith", "belief", "righteous")),
    ("political", ("struggle", "resist", "fight", "freedom", "liberation", "rights", "justice")),
    ("identity", ("our people", "nation", "homeland", "us versus them")),
)

# Score used when a row has no model result.
FALLBACK_PROBS: tuple[float, ...] = (0.5, 0.2, 0.2, 0.1)

# Reasoning sentences.
REASON_HIGH_TERMS = "High-risk terms detected: "
REASON_TERMS = "Flagged keywords found: "
REASON_AMPLIFIED = "Rule engine applied amplification due to high-risk content"
REASON_BIAS = "Potential context-sensitive bias detected (sensitive categories)"
REASON_REVIEW = "Flagged for human review due to ambiguity or potential bias"
REASON_NO_MODEL = " (ML model unavailable: no model score for this row)"

# Declared limits.
MAX_INPUT_CHARS = 10_000
MAX_BATCH_TEXTS = 1_000
MAX_API_BATCH_TEXTS = 100
MODEL_MAX_TOKENS = 256
CHUNK_SIZE = 8
RATE_LIMITS = {"single": 60, "batch": 30, "file": 30}  # requests a minute and client
# Review: confidence threshold and inclusive borderline bands of the risk.
REVIEW_CONFIDENCE = 0.7
REVIEW_BANDS: tuple[tuple[int, int], ...] = ((20, 30), (45, 55), (70, 80))
BIAS_REVIEW_MIN_RISK = 25
# Disparate impact.
DI_THRESHOLD = 0.8
DI_HIGH_BELOW = 0.5

# Null tokens for the labelled CSV scan (the pandas default set).
CSV_NULL_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# ---------------------------------------------------------------------------
# Parameters
# ---------------------------------------------------------------------------

#: Label cut-points.  ``(25, 50, 75)`` is the intended behaviour (tests and
#: review bands sit on it); ``(50, 75, 100)`` is what the label function of
#: the original code does.  Both are offered as queries.
CUTPOINTS_INTENDED: tuple[int, int, int] = (25, 50, 75)
CUTPOINTS_AS_CODED: tuple[int, int, int] = (50, 75, 100)


@dataclass(frozen=True)
class Lexicon:
    """Keyword and pattern rules.  ``ord`` is file order across both kinds."""

    keywords: tuple[tuple[str, tuple[str, ...]], ...] = KEYWORDS
    patterns: tuple[tuple[str, tuple[str, ...]], ...] = PATTERNS
    severity_weights: dict[str, int] = field(default_factory=lambda: dict(SEVERITY_WEIGHTS))
    # Every pattern hit is worth this much; per-category weights of the
    # rules file are declared but never applied.
    pattern_weight: int = 2
    high_group: str = "high_risk"

    def weight(self, severity: str) -> int:
        return int(self.severity_weights.get(severity, 1))

    def all_keywords(self) -> list[str]:
        return [t for _, terms in self.keywords for t in terms]

    def rows(self) -> list[tuple[int, str, str, str, int]]:
        """(ord, kind, group, term, weight) in file order."""
        out: list[tuple[int, str, str, str, int]] = []
        for sev, terms in self.keywords:
            for t in terms:
                out.append((len(out), "keyword", sev, t, self.weight(sev)))
        for cat, pats in self.patterns:
            for p in pats:
                out.append((len(out), "pattern", cat, p, self.pattern_weight))
        return out

    @staticmethod
    def from_yaml(path: str | Path) -> "Lexicon":
        """Load a rules file with optional ``keywords``, ``patterns`` and
        ``severity_weights`` sections; section and list order is kept."""
        import yaml

        p = Path(path)
        if not p.exists():
            raise FileNotFoundError(f"Rules file not found: {p}")
        with open(p, encoding="utf-8") as f:
            doc = yaml.safe_load(f) or {}
        kws = tuple((str(k), tuple(str(t) for t in (v or ()))) for k, v in (doc.get("keywords") or {}).items())
        pats = tuple((str(k), tuple(str(t) for t in (v or ()))) for k, v in (doc.get("patterns") or {}).items())
        weights = {str(k): int(v) for k, v in (doc.get("severity_weights") or {}).items()}
        return Lexicon(keywords=kws, patterns=pats, severity_weights=weights)


DEFAULT_LEXICON = Lexicon()


@dataclass(frozen=True)
class FusionParams:
    """Score fusion parameters.  Weights are normalised when their sum is
    positive and not 1, exactly as the original constructor does."""

    rule_weight: float = 0.3
    ml_weight: float = 0.7
    amplification: float = 1.5
    cutpoints: tuple[int, int, int] = CUTPOINTS_INTENDED
    review_confidence: float = REVIEW_CONFIDENCE
    review_bands: tuple[tuple[int, int], ...] = REVIEW_BANDS
    bias_review_min_risk: int = BIAS_REVIEW_MIN_RISK
    confidence_boost: float = 1.2

    def normalised(self) -> "FusionParams":
        total = self.rule_weight + self.ml_weight
        if total != 1.0 and total > 0:
            return FusionParams(
                rule_weight=self.rule_weight / total,
                ml_weight=self.ml_weight / total,
                amplification=self.amplification,
                cutpoints=self.cutpoints,
                review_confidence=self.review_confidence,
                review_bands=self.review_bands,
                bias_review_min_risk=self.bias_review_min_risk,
                confidence_boost=self.confidence_boost,
            )
        return self


DEFAULT_FUSION = FusionParams()
AS_CODED_FUSION = FusionParams(cutpoints=CUTPOINTS_AS_CODED)
