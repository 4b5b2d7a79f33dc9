"""Inputs derived from the supplied tables for checked queries.

The supplied ``documents`` are invented prose that almost never hits the
lexicon, so checked queries read a *seeded corpus*: every document keeps
its whole text and gets one fixed phrase appended, chosen by
``doc_id % 16``.  Every row stays; the work grows with the table.  The
phrases cover every rule path (severities, multi-word terms, apostrophes,
URL / mention / e-mail removal, emoji, the risk cap).

Model scores for exact checks are a fixed table of probabilities chosen by
``doc_id % 5``; rows with ``doc_id % 7 = 0`` have no score and exercise the
fallback.  A production job passes real scores instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import KEYWORDS

# ---------------------------------------------------------------------------
# FIXED VALUES: seed phrases (index = doc_id % 16) and fixture scores
# ---------------------------------------------------------------------------
SEED_PHRASES: tuple[str, ...] = (
    "",
    "fight for freedom and rights",
    "the enemy is corrupt",
    "stop the attack and the violence",
    "our people love the homeland",
    "faith, belief and a jihad within",
    "they must rise up and rise up again",
    "the recruitment drive is complicity",
    "killing time with a radicalized nationality",
    "the enemy's 'evil' plan",
    "our'people and holy  war",
    "see https://ex.com/kill?q=attack&bomb #terror",
    "mail kill@bomb.com or @martyr now",
    "KILL the Traitor! \U0001F600wicked\U0001F600",
    "wake up they don't want you to know",
    " ".join(t for _, terms in KEYWORDS for t in terms) + " new world order no quarter",
)

#: Probabilities (Non, Mild, Moderate, High) by doc_id % 5.
FIXTURE_PROBS: tuple[tuple[float, float, float, float], ...] = (
    (0.97, 0.01, 0.01, 0.01),
    (0.55, 0.25, 0.15, 0.05),
    (0.10, 0.60, 0.20, 0.10),
    (0.05, 0.10, 0.70, 0.15),
    (0.00, 0.01, 0.04, 0.95),
)
NO_SCORE_MODULUS = 7


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table.  A caller whose files arrive in too few splits (a
    bench on one small row group) asks for more partitions by the setting
    ``spark.riskscope.inputPartitions``; unset, the scan is left as it is."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get("spark.riskscope.inputPartitions", None)
    return df.repartition(int(n)) if n else df


def seed_phrase(key: Column) -> Column:
    expr = None
    for i, p in enumerate(SEED_PHRASES):
        expr = (F.when(key % 16 == i, F.lit(p)) if expr is None else expr.when(key % 16 == i, F.lit(p)))
    return expr


def seeded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``text || ' ' || phrase(doc_id % 16)``."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.col("text"), F.lit(" "), seed_phrase(F.col("doc_id"))).alias("text"),
                       "lang", "source")


def probs_by_bucket(k: Column) -> Column:
    expr = None
    for i, row in enumerate(FIXTURE_PROBS):
        arr = F.array(*[F.lit(float(v)) for v in row])
        expr = F.when(k == i, arr) if expr is None else expr.when(k == i, arr)
    return expr


def fixture_probs(key: Column) -> Column:
    """In-row probabilities (null = no model result)."""
    return F.when(key % NO_SCORE_MODULUS == 0, F.lit(None).cast("array<double>")).otherwise(probs_by_bucket(key % 5))


def text_fixture_probs(text: Column) -> Column:
    """A deterministic stand-in model over the text itself (length % 5)."""
    return probs_by_bucket(F.length(text) % 5)


def fixture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed scores table ``(doc_id, probs)`` as an external scorer would
    write it; ``probs`` is null where the model gave no result."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return docs.select("doc_id", fixture_probs(F.col("doc_id")).alias("probs"))


def four_class_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as a 4-class truth: ``2*toxic + (1-quality)``."""
    lab = read_table(spark, sf_dir, "labels")
    return lab.select("doc_id", (F.col("toxic") * 2 + (F.lit(1) - F.col("quality"))).cast("int").alias("label"))
