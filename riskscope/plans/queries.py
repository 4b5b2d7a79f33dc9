"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the supplied tables (or a
frame Spark derives from them) in full.  Faults that the checks need (null,
empty, blank text, bad labels) are injected by a fixed rule on the key in
both the Spark builder and its SQL, never by dropping rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, model_tokens, preprocess, tokenize, truncate, ustrip
from ..operators import dataset as D
from ..operators import fairness as FA
from ..operators import metrics as M
from ..operators import rules as R
from ..operators import scoring as S
from ..operators import validation as V
from ..params import AS_CODED_FUSION, DEFAULT_FUSION, LABELS
from . import oracle as O
from .classify import (
    audit_view, batch_request_ids, chunk_request_ids, classify, csv_view, flat_result, raw_view, review_queue,
)
from .corpus import fixture_probs, four_class_truth, read_table, seeded_corpus, text_fixture_probs

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


q = O.q

# --------------------------------------------------------------------------
# shared inputs
# --------------------------------------------------------------------------


def classified_corpus(spark: SparkSession, sf_dir: str, params=DEFAULT_FUSION) -> DataFrame:
    docs = seeded_corpus(spark, sf_dir).withColumn("probs", fixture_probs(F.col("doc_id")))
    return classify(docs, params=params)


def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classification written once to the shared checkpoint folder; the
    reports read it (classify once, report many times).  Reading a stored
    table also keeps Catalyst from inlining the whole classification chain
    into report expressions that reach into nested result fields."""
    from ..session import materialize
    cols = ["doc_id", "lang", "source", "label", "risk_score", "confidence", "requires_human_review",
            "review_reasons", "bias_metadata", "ml_label_id", "rule_terms"]
    return materialize(classified_corpus(spark, sf_dir).select(*cols))


def cleaned_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_corpus(spark, sf_dir).withColumn("cleaned", clean("text"))


def ruled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match_rules(cleaned_corpus(spark, sf_dir), "cleaned")


CLS = O.classified_ctes()


def _with(select: str, ctes: str = CLS, source: str = "fused3", tail: str = "") -> str:
    return f"WITH {ctes}\nSELECT {select} FROM {source} {tail}"


RULED_CTES = f"""
src AS ({O.corpus_sql()}),
cl AS (SELECT *, {O.clean_sql('text')} AS cleaned FROM src),
ru AS (SELECT *, {O.rules_select_sql('cleaned')} FROM cl),
ru2 AS (SELECT *, {O.rule_derived_sql()} FROM ru)"""


def _sev_names():
    from ..params import KEYWORDS
    return [s for s, _ in KEYWORDS]


# --------------------------------------------------------------------------
# C: text functions
# --------------------------------------------------------------------------

@register("clean_text", f"WITH src AS ({O.corpus_sql()}) SELECT doc_id, {O.clean_sql('text')} AS cleaned FROM src")
def q_clean_text(spark, sf_dir):
    return cleaned_corpus(spark, sf_dir).select("doc_id", "cleaned")


@register("tokenize", f"""WITH src AS ({O.corpus_sql()}),
cl AS (SELECT doc_id, {O.clean_sql('text')} AS cleaned FROM src),
tk AS (SELECT doc_id, {O.tokens_sql('cleaned')} AS tokens FROM cl)
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS token_count, CAST(len(tokens[1:256]) AS INTEGER) AS model_token_count,
  md5(array_to_string(tokens, '|')) AS tokens_md5 FROM tk""")
def q_tokenize(spark, sf_dir):
    df = cleaned_corpus(spark, sf_dir).withColumn("tokens", tokenize("cleaned"))
    return df.select("doc_id", F.size("tokens").alias("token_count"),
                     F.size(model_tokens("tokens", 256)).alias("model_token_count"),
                     F.md5(F.array_join("tokens", "|")).alias("tokens_md5"))



def _padded_text(t: Column, key: Column) -> Column:
    # leading / trailing Unicode whitespace on some rows, by key
    return (F.when(key % 4 == 0, F.concat(F.lit("\u00a0\t "), t, F.lit(" \n\u3000")))
            .when(key % 4 == 1, F.concat(t, F.lit("\u2028"))).otherwise(t))


PADDED_SQL = ("(CASE WHEN doc_id % 4 = 0 THEN chr(160) || chr(9) || ' ' || text || ' ' || chr(10) || chr(12288) "
              "WHEN doc_id % 4 = 1 THEN text || chr(8232) ELSE text END)")


@register("normalize_text", f"""SELECT doc_id, CAST(length({O.ustrip_sql(PADDED_SQL)}) AS INTEGER) AS stripped_chars,
  md5({O.ustrip_sql(PADDED_SQL)}) AS stripped_md5 FROM documents""")
def q_normalize_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    s = ustrip(_padded_text(F.col("text"), F.col("doc_id")))
    return d.select("doc_id", F.length(s).alias("stripped_chars"), F.md5(s).alias("stripped_md5"))


# --------------------------------------------------------------------------
# D: rules
# --------------------------------------------------------------------------

@register("keyword_hits", _with("doc_id, array_to_string(kw_hits, ',') AS kw_hits, kw_points", RULED_CTES, "ru2"))
def q_keyword_hits(spark, sf_dir):
    return ruled_corpus(spark, sf_dir).select("doc_id", F.array_join("kw_hits", ",").alias("kw_hits"), "kw_points")


_SEV_SQL = "concat_ws(';', " + ", ".join(
    f"CASE WHEN len(kw_{i}) > 0 THEN {q(s)} || ':' || array_to_string(kw_{i}, '|') END"
    for i, s in enumerate(_sev_names())) + ")"


@register("severity_breakdown", _with(f"doc_id, {_SEV_SQL} AS breakdown", RULED_CTES, "ru2"))
def q_severity_breakdown(spark, sf_dir):
    df = ruled_corpus(spark, sf_dir)
    s = F.array_join(F.transform(F.map_entries("kw_by_severity"),
                                 lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "|"))), ";")
    return df.select("doc_id", s.alias("breakdown"))


@register("pattern_hits", _with("doc_id, array_to_string(pat_terms, '|') AS patterns, "
                                "array_to_string(pat_cats, '|') AS categories, pattern_count", RULED_CTES, "ru2"))
def q_pattern_hits(spark, sf_dir):
    df = ruled_corpus(spark, sf_dir)
    return df.select("doc_id", F.array_join(F.transform("pattern_hits", lambda x: x["pattern"]), "|").alias("patterns"),
                     F.array_join(F.transform("pattern_hits", lambda x: x["category"]), "|").alias("categories"),
                     "pattern_count")


@register("rule_analyze", _with("doc_id, rule_risk, rule_flagged, has_high_risk, "
                                "array_to_string(rule_terms, ', ') AS rule_terms, "
                                "array_to_string(high_terms, ', ') AS high_terms", RULED_CTES, "ru2"))
def q_rule_analyze(spark, sf_dir):
    df = ruled_corpus(spark, sf_dir)
    return df.select("doc_id", "rule_risk", "rule_flagged", "has_high_risk",
                     F.array_join("rule_terms", ", ").alias("rule_terms"),
                     F.array_join("high_terms", ", ").alias("high_terms"))


def _rules_values_sql() -> str:
    from ..params import DEFAULT_LEXICON
    rows = ", ".join(f"({o}, {q(k)}, {q(g)}, {q(t)}, {w})" for o, k, g, t, w in DEFAULT_LEXICON.rows())
    return f"SELECT * FROM (VALUES {rows}) AS r(ord, kind, grp, term, weight)"


LONG_SQL = f"""WITH src AS ({O.corpus_sql()}),
cl AS (SELECT doc_id, {O.clean_sql('text')} AS cleaned FROM src),
rl AS ({_rules_values_sql()}),
hits AS (
  SELECT cl.doc_id, CAST(rl.ord AS INTEGER) AS ord, rl.kind, rl.grp AS "group", rl.term, CAST(rl.weight AS INTEGER) AS weight
  FROM cl JOIN rl ON (
    (rl.kind = 'keyword' AND regexp_matches(cl.cleaned, '\\b' || rl.term || '\\b'))
    OR (rl.kind = 'pattern' AND contains(cl.cleaned, rl.term))))"""


@register("rule_hits_long", LONG_SQL + "\nSELECT * FROM hits")
def q_rule_hits_long(spark, sf_dir):
    return R.rule_hits_long(cleaned_corpus(spark, sf_dir), R.rules_frame(spark), "doc_id", "cleaned")


@register("rule_group_stats", LONG_SQL + """
SELECT kind, "group", count(DISTINCT doc_id) AS docs, count(*) AS hits, CAST(sum(weight) AS BIGINT) AS points
FROM hits GROUP BY kind, "group" """)
def q_rule_group_stats(spark, sf_dir):
    long_ = R.rule_hits_long(cleaned_corpus(spark, sf_dir), R.rules_frame(spark), "doc_id", "cleaned")
    return R.rule_group_stats(long_, "doc_id")


@register("term_frequency", LONG_SQL + """
SELECT ord, kind, "group", term, count(*) AS docs FROM hits GROUP BY ord, kind, "group", term""")
def q_term_frequency(spark, sf_dir):
    long_ = R.rule_hits_long(cleaned_corpus(spark, sf_dir), R.rules_frame(spark), "doc_id", "cleaned")
    return R.term_frequency(long_)


@register("rule_terms_via_join", _with("doc_id, array_to_string(rule_terms, ', ') AS rule_terms", RULED_CTES, "ru2",
                                       "WHERE len(rule_terms) > 0"))
def q_rule_terms_via_join(spark, sf_dir):
    """Invariant: the join plan gives the same terms in the same order as the
    literal plan (documents without any hit have no row here)."""
    long_ = R.rule_hits_long(cleaned_corpus(spark, sf_dir), R.rules_frame(spark), "doc_id", "cleaned")
    return R.collect_hits(long_, "doc_id").select("doc_id", F.array_join("rule_terms", ", ").alias("rule_terms"))


# --------------------------------------------------------------------------
# E: scoring
# --------------------------------------------------------------------------

def _logits(doc_id: Column, n_chars: Column) -> Column:
    """Deterministic logits from document fields (a stand-in model output)."""
    return F.array((doc_id % 7).cast("double") * F.lit(0.5), (n_chars % 11).cast("double") * F.lit(0.3),
                   (doc_id % 3).cast("double"), (n_chars % 5).cast("double") * F.lit(0.7))


LOGITS_SQL = ("[CAST(doc_id % 7 AS DOUBLE) * CAST(0.5 AS DOUBLE), CAST(n_chars % 11 AS DOUBLE) * CAST(0.3 AS DOUBLE), "
              "CAST(doc_id % 3 AS DOUBLE), CAST(n_chars % 5 AS DOUBLE) * CAST(0.7 AS DOUBLE)]")


def _r6(x: str) -> str:
    return f"floor(({x}) * CAST(1000000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000.0 AS DOUBLE)"


@register("score_logits", f"""WITH lg AS (SELECT doc_id, {LOGITS_SQL} AS logits FROM documents),
ex AS (SELECT doc_id, list_transform(logits, lambda v: exp(v - list_max(logits))) AS e FROM lg),
pr AS (SELECT doc_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM ex)
SELECT doc_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS label_id,
  ({O.qlist(LABELS)})[list_position(p, list_max(p))] AS label, {_r6('list_max(p)')} AS confidence,
  {_r6('p[1]')} AS p0, {_r6('p[2]')} AS p1, {_r6('p[3]')} AS p2, {_r6('p[4]')} AS p3 FROM pr""")
def q_score_logits(spark, sf_dir):
    from ..operators.fusion import round_half_up as rh
    d = read_table(spark, sf_dir, "documents").select("doc_id", _logits(F.col("doc_id"), F.col("n_chars")).alias("logits"))
    s = S.score_logits(d, "logits")
    return s.select("doc_id", F.col("ml_label_id").alias("label_id"), F.col("ml_label").alias("label"),
                    rh(F.col("ml_confidence"), 6).alias("confidence"),
                    *[rh(F.element_at("ml_probs", i + 1), 6).alias(f"p{i}") for i in range(4)])


@register("fine_grained_scores", f"""WITH s AS (SELECT doc_id, coalesce({O.fixture_probs_sql()}, {O.dlist((0.5, 0.2, 0.2, 0.1))}) AS p FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS label_id, p[i] AS prob FROM s, range(1, 5) t(i)""")
def q_fine_grained_scores(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", fixture_probs(F.col("doc_id")).alias("probs"))
    return S.fine_grained_scores(S.score_probs(d, "probs"), "doc_id", "ml_probs")


@register("score_fallback", f"""WITH m AS (SELECT doc_id, {O.ml_select_sql(O.fixture_probs_sql())} FROM documents),
m2 AS (SELECT *, {O.ml_derived_sql()} FROM m)
SELECT doc_id, ml_missing, ml_label, ml_confidence, ml_probs[1] AS p_non_radical, ml_probs[2] AS p_mildly_radical,
  ml_probs[3] AS p_moderately_radical, ml_probs[4] AS p_highly_radical FROM m2""")
def q_score_fallback(spark, sf_dir):
    """E4 (fallback when the scores table has no row) and E2 (the map)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    joined = S.attach_scores(d, from_scores_table(spark, sf_dir), "doc_id", "probs")
    s = S.score_probs(joined, "probs").withColumn("pm", S.probabilities_map("ml_probs"))
    return s.select("doc_id", "ml_missing", "ml_label", "ml_confidence",
                    *[F.col("pm")[lab].alias("p_" + lab.lower().replace("-", "_").replace(" ", "_")) for lab in LABELS])


def from_scores_table(spark, sf_dir) -> DataFrame:
    from .corpus import fixture_scores
    return fixture_scores(spark, sf_dir)


@register("distinct_scoring", f"""WITH m AS (SELECT doc_id, {O.ml_select_sql(O.probs_by_bucket_sql('length(text) % 5'))} FROM documents),
m2 AS (SELECT *, {O.ml_derived_sql()} FROM m) SELECT doc_id, ml_label, ml_confidence FROM m2""")
def q_distinct_scoring(spark, sf_dir):
    """Each distinct text scored once, joined back; equals scoring every row."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = S.score_distinct(d, "text", lambda u: u.withColumn("probs", text_fixture_probs(F.col("text"))))
    return S.score_probs(scored, "probs").select("doc_id", "ml_label", "ml_confidence")


@register("distinct_scoring_by_conversation", f"""WITH m AS (SELECT conv_id, turn, {O.ml_select_sql(O.probs_by_bucket_sql('length(text) % 5'))} FROM conversations),
m2 AS (SELECT *, {O.ml_derived_sql()} FROM m) SELECT conv_id, turn, ml_label, ml_confidence FROM m2""")
def q_distinct_scoring_by_conversation(spark, sf_dir):
    """E7 on a key that repeats: the turns of conversations, by conv_id."""
    d = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    scored = S.score_distinct(d, "text", lambda u: u.withColumn("probs", text_fixture_probs(F.col("text"))), key="conv_id")
    return S.score_probs(scored, "probs").select("conv_id", "turn", "ml_label", "ml_confidence")


# --------------------------------------------------------------------------
# F: fusion
# --------------------------------------------------------------------------

_MLR = " + ".join(f"ml_probs[{i + 1}] * CAST({w!r} AS DOUBLE)" for i, w in enumerate((0.0, 0.33, 0.66, 1.0)))


@register("fuse_risk", _with(f"doc_id, rule_risk, ({_MLR}) AS ml_risk, risk_score"))
def q_fuse_risk(spark, sf_dir):
    from ..operators.fusion import ml_risk
    return classified_corpus(spark, sf_dir).select("doc_id", "rule_risk", ml_risk(F.col("ml_probs")).alias("ml_risk"),
                                                   "risk_score")


@register("label_intended", _with("doc_id, risk_score, label"))
def q_label_intended(spark, sf_dir):
    return classified_corpus(spark, sf_dir).select("doc_id", "risk_score", "label")


@register("label_as_coded", _with("doc_id, risk_score, label", O.classified_ctes(params=AS_CODED_FUSION)))
def q_label_as_coded(spark, sf_dir):
    return classified_corpus(spark, sf_dir, AS_CODED_FUSION).select("doc_id", "risk_score", "label")


@register("confidence", _with("doc_id, confidence"))
def q_confidence(spark, sf_dir):
    return classified_corpus(spark, sf_dir).select("doc_id", "confidence")


@register("review_flags", _with("doc_id, requires_human_review, array_to_string(review_reasons, ',') AS review_reasons"))
def q_review_flags(spark, sf_dir):
    return classified_corpus(spark, sf_dir).select("doc_id", "requires_human_review",
                                                   F.array_join("review_reasons", ",").alias("review_reasons"))


@register("bias_check", _with("doc_id, high_bias_risk AS bias_risk, array_to_string(detected_categories, ',') AS bias_categories, "
                              "array_to_string(list_transform(risk_factors, lambda f: f.category || '=' || "
                              "array_to_string(f.terms, '|')), ';') AS bias_terms"))
def q_bias_check(spark, sf_dir):
    return flat_result(classified_corpus(spark, sf_dir)).select("doc_id", "bias_risk", "bias_categories", "bias_terms")


@register("reasoning", _with("doc_id, reasoning"))
def q_reasoning(spark, sf_dir):
    return classified_corpus(spark, sf_dir).select("doc_id", "reasoning")


# --------------------------------------------------------------------------
# I / B8-B11 / S8, S14: classification and its projections
# --------------------------------------------------------------------------

@register("classify_default", _with(O.flat_result_select()))
def q_classify_default(spark, sf_dir):
    return flat_result(classified_corpus(spark, sf_dir))


@register("classify_truncated", _with(O.flat_result_select(), O.classified_ctes(max_chars=10_000)))
def q_classify_truncated(spark, sf_dir):
    """I1 with the original service's input cut: texts over 10,000 code
    points are classified on their first 10,000 (B4).  The default
    classification reads whole texts."""
    docs = seeded_corpus(spark, sf_dir).withColumn("probs", fixture_probs(F.col("doc_id")))
    return flat_result(classify(docs, max_chars=10_000))


@register("classify_documents_raw", _with(
    O.flat_result_select(),
    O.classified_ctes(source_sql="SELECT doc_id, text, lang, source FROM documents")))
def q_classify_documents_raw(spark, sf_dir):
    """The supplied documents as they are (no seed phrase)."""
    d = read_table(spark, sf_dir, "documents").withColumn("probs", fixture_probs(F.col("doc_id")))
    return flat_result(classify(d))


CONV_SRC = "SELECT conv_id, turn, role, text FROM conversations"


@register("classify_batch_ids", _with(
    "conv_id || '_' || turn AS request_id, label, risk_score, confidence",
    O.classified_ctes(source_sql=CONV_SRC, probs_sql=O.probs_by_bucket_sql("length(text) % 5"), key="conv_id")))
def q_classify_batch_ids(spark, sf_dir):
    """I2 on conversations: a conversation is a batch, its turn the item index."""
    c = read_table(spark, sf_dir, "conversations").withColumn("probs", text_fixture_probs(F.col("text")))
    out = batch_request_ids(classify(c), "conv_id", "turn")
    return out.select("request_id", "label", "risk_score", "confidence")


CONV_FAULT_SQL = ("SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 23 = 0 THEN '' ELSE text END AS text "
                  "FROM conversations")


@register("classify_valid_batches", f"""WITH {O.classified_ctes(
    source_sql=CONV_FAULT_SQL + " WHERE conv_id NOT IN (SELECT conv_id FROM (" + CONV_FAULT_SQL + ") c WHERE text = '')",
    probs_sql=O.probs_by_bucket_sql('length(text) % 5'), key='conv_id')}
SELECT conv_id || '_' || turn AS request_id, label, risk_score FROM fused3""")
def q_classify_valid_batches(spark, sf_dir):
    """I2 + B2: conversations are batches; a conversation holding an empty
    turn (injected by a fixed key rule) is rejected as a whole, the others
    are classified."""
    from .classify import classify_batches
    c = read_table(spark, sf_dir, "conversations")
    c = c.withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 23 == 0, F.lit("")).otherwise(F.col("text")))
    c = c.withColumn("probs", text_fixture_probs(F.col("text")))
    results, _rejects = classify_batches(c, "conv_id", "turn")
    return results.select("request_id", "label", "risk_score")


@register("classify_chunk_ids", _with(
    "conv_id || '_chunk_' || CAST(turn // 3 AS VARCHAR) || '_' || CAST(turn % 3 AS VARCHAR) AS request_id, "
    "CAST(turn // 3 AS BIGINT) AS chunk_id, CAST(turn % 3 AS BIGINT) AS chunk_pos, label",
    O.classified_ctes(source_sql=CONV_SRC, probs_sql=O.probs_by_bucket_sql("length(text) % 5"), key="conv_id")))
def q_classify_chunk_ids(spark, sf_dir):
    """``<batch>_chunk_<k>_<j>`` ids, chunks of 3."""
    c = read_table(spark, sf_dir, "conversations").withColumn("probs", text_fixture_probs(F.col("text")))
    out = chunk_request_ids(classify(c), "conv_id", "turn", 3)
    return out.select("request_id", "chunk_id", "chunk_pos", "label")


@register("result_csv_view", _with("doc_id, label, confidence, risk_score, array_to_string(rule_terms, ', ') AS flagged_terms, reasoning"))
def q_result_csv_view(spark, sf_dir):
    return csv_view(classified_corpus(spark, sf_dir))


@register("audit_view", _with(
    "doc_id, CAST(doc_id AS VARCHAR) AS request_id, label, risk_score, confidence, requires_human_review, "
    "high_bias_risk AS bias_risk, CASE WHEN length(input) > 100 THEN substring(input, 1, 100) || '...' ELSE input END AS preview"))
def q_audit_view(spark, sf_dir):
    return audit_view(classified_corpus(spark, sf_dir))


@register("review_queue", _with("doc_id, label, risk_score, confidence, array_to_string(review_reasons, ',') AS review_reasons",
                                tail="WHERE len(review_reasons) > 0 ORDER BY risk_score DESC, doc_id"))
def q_review_queue(spark, sf_dir):
    return review_queue(results_table(spark, sf_dir))


@register("label_only", _with("doc_id, label"))
def q_label_only(spark, sf_dir):
    return classified_corpus(spark, sf_dir).select("doc_id", "label")


@register("classify_raw", None)
def q_classify_raw(spark, sf_dir):
    """Intermediates nested (rows-only check)."""
    return raw_view(classified_corpus(spark, sf_dir))


# --------------------------------------------------------------------------
# Validation and ingest
# --------------------------------------------------------------------------

def _faulty_text(t: Column, key: Column) -> Column:
    """Null, empty and whitespace-only text on a few keys."""
    return (F.when(key % 50 == 3, F.lit(None).cast("string")).when(key % 50 == 4, F.lit(""))
            .when(key % 50 == 5, F.lit(" \t\u00a0")).otherwise(t))


FAULTY_SQL = ("(CASE WHEN doc_id % 50 = 3 THEN NULL WHEN doc_id % 50 = 4 THEN '' "
              "WHEN doc_id % 50 = 5 THEN ' ' || chr(9) || chr(160) ELSE text END)")


def _reason_sql(t: str) -> str:
    return f"(CASE WHEN {t} IS NULL OR {t} = '' THEN 'empty' WHEN {O.ustrip_sql(t)} = '' THEN 'blank' END)"


def _strict_sql(t: str, max_chars: int = 10_000) -> str:
    return (f"(CASE WHEN {t} IS NULL OR {t} = '' THEN 'empty' WHEN length({t}) > {max_chars} THEN 'too_long' "
            f"WHEN {O.ustrip_sql(t)} = '' THEN 'blank' END)")


def faulty_documents(spark, sf_dir) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.withColumn("text", _faulty_text(F.col("text"), F.col("doc_id")))


@register("reject_single", f"WITH f AS (SELECT doc_id, {FAULTY_SQL} AS t FROM documents) "
                           f"SELECT doc_id, {_reason_sql('t')} AS reject_reason FROM f")
def q_reject_single(spark, sf_dir):
    return V.reject_single(faulty_documents(spark, sf_dir)).select("doc_id", "reject_reason")


@register("reject_batch", f"""WITH f AS (SELECT doc_id, source, {FAULTY_SQL} AS t FROM documents)
SELECT source, count(*) AS batch_size, min(CASE WHEN t IS NULL OR t = '' THEN doc_id END) AS first_empty_idx,
  CASE WHEN count(*) > 1000 THEN 'batch_too_large'
       WHEN min(CASE WHEN t IS NULL OR t = '' THEN doc_id END) IS NOT NULL THEN 'empty_item' END AS verdict
FROM f GROUP BY source""")
def q_reject_batch(spark, sf_dir):
    """B2: a source is a batch, ``doc_id`` the item index."""
    return V.batch_verdicts(faulty_documents(spark, sf_dir), "source", "doc_id", "text", 1000)


@register("reject_strict", f"""WITH f AS (SELECT doc_id, source, {FAULTY_SQL} AS t FROM documents),
n AS (SELECT source, count(*) AS n FROM f GROUP BY source)
SELECT doc_id, CASE WHEN n.n > 100 THEN 'batch_too_large' ELSE {_strict_sql('t')} END AS reject_reason
FROM f JOIN n USING (source)""")
def q_reject_strict(spark, sf_dir):
    """Service profile (1-10,000 characters, not blank, <= 100 per batch)."""
    return V.reject_strict(faulty_documents(spark, sf_dir), "source", "text").select("doc_id", "reject_reason")


@register("truncate_text", """SELECT doc_id, length(text) > 10000 AS was_truncated,
  CAST(length(substring(text, 1, 10000)) AS INTEGER) AS input_chars, md5(substring(text, 1, 10000)) AS input_md5 FROM documents""")
def q_truncate_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    t = truncate("text", 10_000)
    return d.select("doc_id", (F.length("text") > 10_000).alias("was_truncated"), F.length(t).alias("input_chars"),
                    F.md5(t).alias("input_md5"))


def labelled_frame(spark, sf_dir) -> DataFrame:
    """``documents`` joined with the 4-class truth of ``labels``."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return d.join(four_class_truth(spark, sf_dir), "doc_id")


LABELLED_SQL = ("SELECT d.doc_id, d.text, d.lang, CAST(2 * l.toxic + 1 - l.quality AS INTEGER) AS label "
                "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")

FRAME_FAULT_SQL = f"""lf0 AS ({LABELLED_SQL}),
lf AS (SELECT doc_id, CASE WHEN doc_id % 47 = 0 THEN NULL ELSE text END AS text,
  CASE WHEN doc_id % 37 = 0 THEN CAST(7.0 AS DOUBLE) WHEN doc_id % 41 = 0 THEN CAST(-1.0 AS DOUBLE)
       WHEN doc_id % 43 = 0 THEN NULL WHEN doc_id % 53 = 0 THEN CAST(label AS DOUBLE) + CAST(0.5 AS DOUBLE)
       ELSE CAST(label AS DOUBLE) END AS label FROM lf0)"""


@register("frame_checks", f"""WITH {FRAME_FAULT_SQL},
s AS (SELECT count(*) AS "rows", count(*) FILTER (WHERE text IS NULL) AS null_text,
  count(*) FILTER (WHERE label IS NULL) AS null_label,
  count(*) FILTER (WHERE label IS NOT NULL AND label <> floor(label)) AS non_integer_labels,
  count(*) FILTER (WHERE label = floor(label) AND (label < 0 OR label >= 4)) AS out_of_range
  FROM lf),
a AS (SELECT coalesce(array_to_string(list_sort(list(doc_id)), ','), '') AS first_null_text_keys
  FROM (SELECT doc_id FROM lf WHERE text IS NULL ORDER BY doc_id LIMIT 15)),
b AS (SELECT coalesce(array_to_string(list_sort(list(doc_id)), ','), '') AS first_null_label_keys
  FROM (SELECT doc_id FROM lf WHERE label IS NULL ORDER BY doc_id LIMIT 15))
SELECT *, (null_text = 0 AND null_label = 0 AND non_integer_labels = 0 AND out_of_range = 0) AS valid FROM s, a, b""")
def q_frame_checks(spark, sf_dir):
    """B5 on the labelled frame with injected null text and bad labels."""
    return V.frame_checks(faulty_labels(spark, sf_dir), "doc_id", 4)


def faulty_labels(spark, sf_dir) -> DataFrame:
    lf = labelled_frame(spark, sf_dir)
    k, lab = F.col("doc_id"), F.col("label").cast("double")
    return lf.select("doc_id",
                     F.when(k % 47 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("text"),
                   F.when(k % 37 == 0, F.lit(7.0)).when(k % 41 == 0, F.lit(-1.0))
                   .when(k % 43 == 0, F.lit(None).cast("double")).when(k % 53 == 0, lab + F.lit(0.5))
                   .otherwise(lab).alias("label"))


def _ingest_text(t: Column, key: Column) -> Column:
    return F.when(key % 9 == 0, F.lit(" \t ")).when(key % 9 == 1, F.concat(F.lit("\u00a0"), t, F.lit(" "))).otherwise(t)


INGEST_SQL = "(CASE WHEN doc_id % 9 = 0 THEN ' ' || chr(9) || ' ' WHEN doc_id % 9 = 1 THEN chr(160) || text || ' ' ELSE text END)"
INGEST_CTE = f"""g AS (SELECT doc_id, {O.ustrip_sql(INGEST_SQL)} AS t FROM documents)"""


@register("ingest_stats", f"""WITH {INGEST_CTE}
SELECT count(*) AS rows_in, count(*) FILTER (WHERE length(t) = 0) AS blank_rows,
  count(*) FILTER (WHERE length(t) = 0) AS dropped_empty, count(*) FILTER (WHERE length(t) > 5000) AS truncated_rows,
  CAST(5000 AS INTEGER) AS max_chars, count(*) - count(*) FILTER (WHERE length(t) = 0) AS rows_out FROM g""")
def q_ingest_stats(spark, sf_dir):
    """B6 stats: strip, drop blanks, truncate at 5,000 characters."""
    d = read_table(spark, sf_dir, "documents")
    d = d.withColumn("text", _ingest_text(F.col("text"), F.col("doc_id")))
    _rows, stats = D.normalize(d, "text", drop_empty_text=True, max_text_chars=5000)
    return stats


@register("ingest_rows", f"""WITH {INGEST_CTE}
SELECT doc_id, CAST(length(substring(t, 1, 5000)) AS INTEGER) AS text_chars, md5(substring(t, 1, 5000)) AS text_md5
FROM g WHERE length(t) > 0""")
def q_ingest_rows(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    d = d.withColumn("text", _ingest_text(F.col("text"), F.col("doc_id")))
    rows, _stats = D.normalize(d, "text", drop_empty_text=True, max_text_chars=5000)
    return rows.select("doc_id", F.length("text").alias("text_chars"), F.md5("text").alias("text_md5"))


@register("dedupe_text", """SELECT doc_id, n_chars FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)""")
def q_dedupe_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return D.dedupe_text(d, "doc_id", "text").select("doc_id", "n_chars")


# --------------------------------------------------------------------------
# splits
# --------------------------------------------------------------------------

@register("label_histogram", "SELECT CAST(2 * toxic + 1 - quality AS INTEGER) AS label, count(*) AS n FROM labels GROUP BY 1")
def q_label_histogram(spark, sf_dir):
    return D.label_histogram(four_class_truth(spark, sf_dir))


def split_sql(source: str, fr: tuple[float, float, float], seed: int = 42) -> str:
    """CTEs ``sp`` (doc_id, label, split, ...) over CTE ``source``."""
    _tr, va, te = fr
    d = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    return f"""cnt AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
tot AS (SELECT sum(n) AS total_n FROM cnt),
qt AS (SELECT c.label, c.n, t.total_n,
  CAST(floor(CAST(t.total_n AS DOUBLE) * {d(te)} + {d(0.5)}) AS BIGINT) AS t_test,
  CAST(floor(CAST(t.total_n AS DOUBLE) * {d(va)} + {d(0.5)}) AS BIGINT) AS t_val FROM cnt c, tot t),
qb AS (SELECT *, (CAST(n AS HUGEINT) * t_test) // total_n AS b_test, (CAST(n AS HUGEINT) * t_test) % total_n AS r_test,
  (CAST(n AS HUGEINT) * t_val) // total_n AS b_val, (CAST(n AS HUGEINT) * t_val) % total_n AS r_val FROM qt),
qr AS (SELECT *, row_number() OVER (ORDER BY r_test DESC, label) AS k_test, row_number() OVER (ORDER BY r_val DESC, label) AS k_val,
  sum(b_test) OVER () AS s_test, sum(b_val) OVER () AS s_val FROM qb),
q1 AS (SELECT label, n, CAST(b_test + CASE WHEN k_test <= t_test - s_test THEN 1 ELSE 0 END AS BIGINT) AS n_test,
  CAST(b_val + CASE WHEN k_val <= t_val - s_val THEN 1 ELSE 0 END AS BIGINT) AS v0 FROM qr),
quota AS (SELECT label, n, n_test, least(v0, n - n_test) AS n_val FROM q1),
rk AS (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}' || ':' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos
  FROM {source} s),
sp AS (SELECT rk.*, CASE WHEN quota.n < 3 THEN NULL WHEN pos < n_test THEN 'test' WHEN pos < n_test + n_val THEN 'val'
  ELSE 'train' END AS split FROM rk JOIN quota USING (label))"""


@register("stratified_split", f"WITH lf AS ({LABELLED_SQL}),\n{split_sql('lf', (0.7, 0.15, 0.15))}\n"
                              "SELECT doc_id, label, split FROM sp")
def q_stratified_split(spark, sf_dir):
    """H1: exact 70/15/15 per class, seed 42."""
    return D.stratified_split(labelled_frame(spark, sf_dir), "doc_id", "label").select("doc_id", "label", "split")


@register("split_80_10_10", f"WITH lf AS ({LABELLED_SQL}),\n{split_sql('lf', (0.8, 0.1, 0.1))}\n"
                            "SELECT doc_id, label, split FROM sp")
def q_split_80_10_10(spark, sf_dir):
    """H2: the 80/10/10 variant."""
    return D.stratified_split(labelled_frame(spark, sf_dir), "doc_id", "label", (0.8, 0.1, 0.1)).select(
        "doc_id", "label", "split")


PREP_SQL = f"""lf0 AS ({LABELLED_SQL}),
lf1 AS (SELECT doc_id, {O.ustrip_sql("(CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END)")} AS text, label FROM lf0),
lf2 AS (SELECT * FROM lf1 WHERE length(text) > 0),
lf AS (SELECT * FROM lf2 WHERE doc_id IN (SELECT min(doc_id) FROM lf2 GROUP BY text)),
{split_sql('lf', (0.7, 0.15, 0.15))}"""


def prepared_split(spark, sf_dir) -> DataFrame:
    """H3: validate -> normalise (strip, drop blanks) -> dedupe -> split."""
    lf = labelled_frame(spark, sf_dir)
    lf = lf.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.lit(" ")).otherwise(F.col("text")))
    rows, _stats = D.normalize(lf, "text", drop_empty_text=True)
    from ..session import materialize
    deduped = materialize(D.dedupe_text(rows, "doc_id", "text"))  # read more than once by the split
    return D.stratified_split(deduped, "doc_id", "label")


@register("prepare_counts", f"WITH {PREP_SQL}\nSELECT split, label, count(*) AS n FROM sp GROUP BY split, label")
def q_prepare_counts(spark, sf_dir):
    return D.split_counts(prepared_split(spark, sf_dir))


@register("split_leak_check", f"""WITH {PREP_SQL},
per AS (SELECT text, count(DISTINCT split) AS k FROM sp GROUP BY text)
SELECT count(*) AS n_texts, count(*) FILTER (WHERE k > 1) AS n_leaked FROM per""")
def q_split_leak_check(spark, sf_dir):
    """No text in two splits after dedupe (anti-join invariant)."""
    sp = prepared_split(spark, sf_dir)
    texts = sp.agg(F.countDistinct(F.sha2("text", 256)).alias("n_texts"))
    return texts.withColumn("n_leaked", F.lit(D.leak_check(sp).count()).cast("bigint"))


@register("manifest_counts", f"""WITH {PREP_SQL},
sc AS (SELECT split, label, count(*) AS n FROM sp GROUP BY split, label),
bs AS (SELECT label, sum(n) AS n FROM sc GROUP BY label)
SELECT split, CAST(sum(n) AS BIGINT) AS "rows", string_agg(CAST(label AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS label_counts FROM sc GROUP BY split
UNION ALL
SELECT 'before_split', CAST(sum(n) AS BIGINT), string_agg(CAST(label AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) FROM bs""")
def q_manifest_counts(spark, sf_dir):
    """G12 counts: rows and label histogram per split and before the split."""
    m = D.manifest_counts(prepared_split(spark, sf_dir))
    return m.select("split", F.col("rows").cast("bigint").alias("rows"),
                    F.array_join(F.transform(F.map_entries("label_counts"),
                                             lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
                    .alias("label_counts"))


# --------------------------------------------------------------------------
# fairness
# --------------------------------------------------------------------------

def _r(x: str, digits: int = 4) -> str:
    k = float(10 ** digits)
    return f"floor(({x}) * CAST({k!r} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({k!r} AS DOUBLE)"


DI_SQL_LOW = "CAST(0.8 AS DOUBLE)"
DI_SQL_HIGH = f"CAST({1 / 0.8!r} AS DOUBLE)"
FAIR_CTES = CLS + f""",
ov AS (SELECT count(*) AS total, count(*) FILTER (WHERE label <> 'Non-Radical') AS flagged_count,
  count(*) FILTER (WHERE high_bias_risk) AS bias_risk_count FROM fused3),
cat AS (SELECT c AS category, count(*) AS total, count(*) FILTER (WHERE label <> 'Non-Radical') AS positive
  FROM (SELECT unnest(detected_categories) AS c, label FROM fused3) GROUP BY c),
con0 AS (SELECT cat.category, CAST(cat.positive AS DOUBLE) / CAST(cat.total AS DOUBLE) AS pr,
  CASE WHEN ov.total = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(ov.flagged_count AS DOUBLE) / CAST(ov.total AS DOUBLE) END AS rr
  FROM cat, ov WHERE cat.total > 0),
con1 AS (SELECT *, CASE WHEN rr = 0 THEN CAST(0.0 AS DOUBLE) ELSE pr / rr END AS di FROM con0),
con AS (SELECT category, {_r('pr')} AS positive_rate, {_r('rr')} AS reference_rate, {_r('di')} AS disparate_impact_ratio,
  CASE WHEN di < 0.5 THEN 'high' ELSE 'medium' END AS severity FROM con1 WHERE di < {DI_SQL_LOW} OR di > {DI_SQL_HIGH}),
sco AS (SELECT count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) FILTER (WHERE severity = 'medium') AS n_medium,
  count(*) AS n_concerns FROM con),
sco2 AS (SELECT *, {_r("greatest(CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE) - (n_high * CAST(0.3 AS DOUBLE) + n_medium * CAST(0.1 AS DOUBLE)) / CAST(greatest(n_concerns, 1) AS DOUBLE))")} AS fairness_score,
  n_high > 0 AS requires_fairness_review FROM sco)"""


@register("fairness_summary", f"""WITH {FAIR_CTES}
SELECT total AS total_processed, flagged_count,
  {_r("CASE WHEN total = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(flagged_count AS DOUBLE) / CAST(total AS DOUBLE) END")} AS flagged_rate,
  bias_risk_count,
  {_r("CASE WHEN total = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(bias_risk_count AS DOUBLE) / CAST(total AS DOUBLE) END")} AS bias_risk_rate,
  CASE WHEN total = 0 THEN CAST(1.0 AS DOUBLE) ELSE fairness_score END AS fairness_score,
  (requires_fairness_review AND total > 0) AS requires_fairness_review FROM ov, sco2""")
def q_fairness_summary(spark, sf_dir):
    return FA.summary(results_table(spark, sf_dir))


@register("fairness_categories", f"WITH {FAIR_CTES}\nSELECT category, total, positive FROM cat")
def q_fairness_categories(spark, sf_dir):
    return FA.category_metrics(results_table(spark, sf_dir))


@register("fairness_history", f"""WITH {FAIR_CTES}, kept AS (SELECT * FROM fused3 WHERE doc_id % 4 <> 0)
SELECT category, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE label <> 'Non-Radical') AS BIGINT) AS positive
FROM (SELECT unnest(detected_categories) AS category, label FROM kept UNION ALL SELECT NULL, label FROM kept) GROUP BY category""")
def q_fairness_history(spark, sf_dir):
    """Four runs are recorded, with a reset after the first; one is recorded
    under its id a second time."""
    from ..streaming.jobs import fresh_dir
    from . import history as H
    res, path = results_table(spark, sf_dir), fresh_dir(spark, "history")
    for part in (0, 1, 2, 1, 3):
        H.record(res.filter(F.col("doc_id") % 4 == part), path, f"run-{part}")
        if part == 0:
            H.reset(spark, path)
    return H.history(spark, path)


@register("fairness_concerns", f"WITH {FAIR_CTES}\nSELECT * FROM con")
def q_fairness_concerns(spark, sf_dir):
    return FA.concerns(results_table(spark, sf_dir))


@register("fairness_score", f"WITH {FAIR_CTES}\nSELECT n_high, n_medium, n_concerns, fairness_score, requires_fairness_review FROM sco2")
def q_fairness_score(spark, sf_dir):
    return FA.fairness_score(FA.concerns(results_table(spark, sf_dir)))


@register("parity_by_lang", CLS.join(["WITH ", ""]) + f""",
g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE label <> 'Non-Radical') AS positive FROM fused3 GROUP BY lang),
g2 AS (SELECT *, CASE WHEN n = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(positive AS DOUBLE) / CAST(n AS DOUBLE) END AS rate FROM g),
rf AS (SELECT coalesce(max(rate), CAST(0.0 AS DOUBLE)) AS ref FROM g2 WHERE lang = 'en')
SELECT lang, n, positive, {_r('rate')} AS positive_rate, {_r('ref')} AS reference_rate,
  {_r('CASE WHEN ref = 0 THEN CAST(0.0 AS DOUBLE) ELSE rate / ref END')} AS disparate_impact_ratio,
  {_r('abs(rate - ref)')} AS parity_difference FROM g2, rf""")
def q_parity_by_lang(spark, sf_dir):
    """Per language against English."""
    return FA.group_rates(classified_corpus(spark, sf_dir), "lang", "en")


@register("equalized_odds_by_lang", CLS.join(["WITH ", ""]) + f""",
j AS (SELECT f.lang, l.toxic AS truth, CASE WHEN f.label <> 'Non-Radical' THEN 1 ELSE 0 END AS pred
  FROM fused3 f JOIN labels l ON f.doc_id = l.doc_id),
g AS (SELECT lang, count(*) FILTER (WHERE truth = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE truth = 1 AND pred <> 1) AS fn,
  count(*) FILTER (WHERE truth <> 1 AND pred = 1) AS fp, count(*) FILTER (WHERE truth <> 1 AND pred <> 1) AS tn FROM j GROUP BY lang),
g2 AS (SELECT *, CASE WHEN tp + fn = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS tpr,
  CASE WHEN fp + tn = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(fp AS DOUBLE) / CAST(fp + tn AS DOUBLE) END AS fpr FROM g),
rf AS (SELECT coalesce(max(tpr), CAST(0.0 AS DOUBLE)) AS rt, coalesce(max(fpr), CAST(0.0 AS DOUBLE)) AS rfp FROM g2 WHERE lang = 'en')
SELECT lang, tp, fn, fp, tn, {_r('tpr')} AS tpr, {_r('fpr')} AS fpr,
  {_r('(abs(tpr - rt) + abs(fpr - rfp)) / CAST(2.0 AS DOUBLE)')} AS equalized_odds_difference FROM g2, rf""")
def q_equalized_odds_by_lang(spark, sf_dir):
    """truth = ``labels.toxic``; predicted positive = label other than
    Non-Radical; per language against English."""
    res = classified_corpus(spark, sf_dir).select("doc_id", "lang", "label")
    j = res.join(read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("truth")), "doc_id")
    j = j.withColumn("pred", F.when(F.col("label") != LABELS[0], 1).otherwise(0))
    return FA.odds_by_group(j, "lang", "en", "truth", "pred")


# --------------------------------------------------------------------------
# G9-G10 counters
# --------------------------------------------------------------------------

COUNTERS_SQL = CLS.join(["WITH ", ""]) + """,
base AS (SELECT label, len(review_reasons) > 0 AS rv, count(*) AS n FROM fused3 GROUP BY 1, 2),
ctr AS (SELECT 'requests_total' AS metric, '' AS key, CAST(coalesce(sum(n), 0) AS BIGINT) AS value FROM base
  UNION ALL SELECT 'label_total', label, CAST(sum(n) AS BIGINT) FROM base GROUP BY label
  UNION ALL SELECT 'review_total', CASE WHEN rv THEN 'review_required' ELSE 'no_review' END, CAST(sum(n) AS BIGINT) FROM base GROUP BY 2)"""


@register("counters", COUNTERS_SQL + "\nSELECT * FROM ctr")
def q_counters(spark, sf_dir):
    return M.counters(classified_corpus(spark, sf_dir))


_METRIC_DIM_SQL = "(VALUES " + ", ".join(f"('{m}', '{h}', '{v}')" for m, (h, v) in M.METRIC_HELP.items()) + ") d(metric, help, vl)"


@register("exposition_lines", COUNTERS_SQL + f"""
SELECT metric || '|2|' || key AS ord, CASE WHEN key = '' THEN 'riskscope_' || metric || ' ' || CAST(value AS VARCHAR)
  ELSE 'riskscope_' || metric || '{{' || vl || '="' || key || '"}} ' || CAST(value AS VARCHAR) END AS line
FROM ctr JOIN {_METRIC_DIM_SQL} USING (metric)
UNION ALL SELECT DISTINCT metric || '|0|', '# HELP riskscope_' || metric || ' ' || help FROM ctr JOIN {_METRIC_DIM_SQL} USING (metric)
UNION ALL SELECT DISTINCT metric || '|1|', '# TYPE riskscope_' || metric || ' counter' FROM ctr""")
def q_exposition_lines(spark, sf_dir):
    return M.exposition_lines(M.counters(classified_corpus(spark, sf_dir)))


# --------------------------------------------------------------------------
# G13-G16 evaluation
# --------------------------------------------------------------------------

def eval_pairs(spark, sf_dir) -> DataFrame:
    """Truth (4-class from ``labels``) against the model prediction."""
    pred = classified_corpus(spark, sf_dir).select("doc_id", F.col("ml_label_id").alias("y_pred"))
    return four_class_truth(spark, sf_dir).select("doc_id", F.col("label").alias("y_true")).join(pred, "doc_id")


PAIRS_SQL = CLS.join(["WITH ", ""]) + """,
pairs AS (SELECT CAST(2 * l.toxic + 1 - l.quality AS INTEGER) AS y_true, f.ml_label_id AS y_pred
  FROM labels l JOIN fused3 f ON l.doc_id = f.doc_id),
cm AS (SELECT y_true, y_pred, count(*) AS n FROM pairs GROUP BY 1, 2),
dim AS (SELECT CAST(i AS INTEGER) AS label_id, (['Non-Radical', 'Mildly Radical', 'Moderately Radical', 'Highly Radical'])[i + 1] AS label FROM range(0, 4) t(i)),
pc0 AS (SELECT dim.label_id, dim.label,
  coalesce(sum(n) FILTER (WHERE y_true = label_id AND y_pred = label_id), 0) AS tp,
  coalesce(sum(n) FILTER (WHERE y_true <> label_id AND y_pred = label_id), 0) AS fp,
  coalesce(sum(n) FILTER (WHERE y_true = label_id AND y_pred <> label_id), 0) AS fn
  FROM dim, cm GROUP BY dim.label_id, dim.label),
pc1 AS (SELECT *, CASE WHEN tp + fp = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS "precision",
  CASE WHEN tp + fn = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall FROM pc0),
pc AS (SELECT label_id, label, "precision", recall,
  CASE WHEN "precision" + recall = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(2.0 AS DOUBLE) * "precision" * recall / ("precision" + recall) END AS f1,
  CAST(tp + fn AS BIGINT) AS support FROM pc1),
tot AS (SELECT CAST(sum(support) AS BIGINT) AS n,
  sum("precision" * support ORDER BY label_id) AS wp, sum(recall * support ORDER BY label_id) AS wr, sum(f1 * support ORDER BY label_id) AS wf,
  sum("precision" ORDER BY label_id) AS mp, sum(recall ORDER BY label_id) AS mr, sum(f1 ORDER BY label_id) AS mf FROM pc),
hit AS (SELECT coalesce(sum(n) FILTER (WHERE y_true = y_pred), 0) AS tp FROM cm)"""


def _r6s(x: str) -> str:
    return _r(x, 6)


@register("confusion_matrix", PAIRS_SQL + "\nSELECT y_true, y_pred, n FROM cm")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion(eval_pairs(spark, sf_dir))


@register("confusion_dense", PAIRS_SQL + """
SELECT y_true, CAST(coalesce(sum(n) FILTER (WHERE y_pred = 0), 0) AS BIGINT) AS p0,
  CAST(coalesce(sum(n) FILTER (WHERE y_pred = 1), 0) AS BIGINT) AS p1,
  CAST(coalesce(sum(n) FILTER (WHERE y_pred = 2), 0) AS BIGINT) AS p2,
  CAST(coalesce(sum(n) FILTER (WHERE y_pred = 3), 0) AS BIGINT) AS p3,
  CAST(coalesce(sum(n) FILTER (WHERE y_pred NOT BETWEEN 0 AND 3), 0) AS BIGINT) AS p_other
FROM (SELECT label_id AS y_true, y_pred, n FROM dim LEFT JOIN cm ON y_true = label_id) GROUP BY y_true""")
def q_confusion_dense(spark, sf_dir):
    return M.confusion_dense(eval_pairs(spark, sf_dir), 4)


@register("per_class_metrics", PAIRS_SQL + f"""
SELECT label_id, label, {_r6s('"precision"')} AS "precision", {_r6s('recall')} AS recall, {_r6s('f1')} AS f1, support FROM pc""")
def q_per_class_metrics(spark, sf_dir):
    from ..operators.fusion import round_half_up as rh
    pc = M.per_class(eval_pairs(spark, sf_dir), 4)
    return pc.select("label_id", "label", rh(F.col("precision"), 6).alias("precision"), rh(F.col("recall"), 6).alias("recall"),
                     rh(F.col("f1"), 6).alias("f1"), "support")


@register("eval_metrics", PAIRS_SQL + f"""
SELECT {_r6s('CASE WHEN n = 0 THEN 0.0 ELSE CAST(hit.tp AS DOUBLE) / CAST(n AS DOUBLE) END')} AS accuracy,
  {_r6s('CASE WHEN n = 0 THEN 0.0 ELSE wp / CAST(n AS DOUBLE) END')} AS "precision",
  {_r6s('CASE WHEN n = 0 THEN 0.0 ELSE wr / CAST(n AS DOUBLE) END')} AS recall,
  {_r6s('CASE WHEN n = 0 THEN 0.0 ELSE wf / CAST(n AS DOUBLE) END')} AS f1, n AS support FROM tot, hit""")
def q_eval_metrics(spark, sf_dir):
    return M.eval_metrics(eval_pairs(spark, sf_dir), 4)


@register("eval_report", PAIRS_SQL + f"""
SELECT label AS "row", {_r6s('"precision"')} AS "precision", {_r6s('recall')} AS recall, {_r6s('f1')} AS f1, support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, {_r6s('CASE WHEN n = 0 THEN 0.0 ELSE wr / CAST(n AS DOUBLE) END')}, n FROM tot
UNION ALL SELECT 'macro avg', {_r6s('mp / CAST(4 AS DOUBLE)')}, {_r6s('mr / CAST(4 AS DOUBLE)')}, {_r6s('mf / CAST(4 AS DOUBLE)')}, n FROM tot
UNION ALL SELECT 'weighted avg', {_r6s('CASE WHEN n = 0 THEN 0.0 ELSE wp / CAST(n AS DOUBLE) END')},
  {_r6s('CASE WHEN n = 0 THEN 0.0 ELSE wr / CAST(n AS DOUBLE) END')}, {_r6s('CASE WHEN n = 0 THEN 0.0 ELSE wf / CAST(n AS DOUBLE) END')}, n FROM tot""")
def q_eval_report(spark, sf_dir):
    return M.eval_report(eval_pairs(spark, sf_dir), 4)


# --------------------------------------------------------------------------
# G17, G18, T5 batch forms
# --------------------------------------------------------------------------

@register("batch_stats", f"""WITH f AS (SELECT doc_id, source, {FAULTY_SQL} AS t FROM documents)
SELECT source, count(*) AS total, count(*) FILTER (WHERE {_reason_sql('t')} IS NULL) AS processed,
  count(*) FILTER (WHERE {_reason_sql('t')} IS NOT NULL) AS failed FROM f GROUP BY source""")
def q_batch_stats(spark, sf_dir):
    """G17 counts per batch (a source is a batch)."""
    return M.batch_stats(V.reject_single(faulty_documents(spark, sf_dir)), "source")


RATE_LIMIT_PER_DAY = 3


@register("rate_limit_flags", f"""SELECT CAST(date_trunc('day', ts) AS DATE) AS window_day, user_id, count(*) AS n
FROM events GROUP BY 1, 2 HAVING count(*) > {RATE_LIMIT_PER_DAY}""")
def q_rate_limit_flags(spark, sf_dir):
    """T5 batch form: users over the limit in a 1-day tumbling window."""
    ev = read_table(spark, sf_dir, "events")
    f = M.rate_limit_flags(ev, "user_id", "ts", "1 day", RATE_LIMIT_PER_DAY)
    return f.select(F.to_date("window_start").alias("window_day"), "user_id", "n")


LIMITS_BY_KIND = {"view": 1, "click": 2, "purchase": 1}
_OVER_KIND = " OR ".join(f"(event_type = '{k}' AND count(*) > {n})" for k, n in LIMITS_BY_KIND.items())


@register("rate_limit_by_kind", f"""SELECT CAST(date_trunc('day', ts) AS DATE) AS window_day, user_id, event_type, count(*) AS n
FROM events GROUP BY 1, 2, 3 HAVING {_OVER_KIND}""")
def q_rate_limit_by_kind(spark, sf_dir):
    """T5 with a limit for each kind of request; kinds without one are never over it."""
    ev = read_table(spark, sf_dir, "events")
    f = M.rate_limit_flags(ev, "user_id", "ts", "1 day", LIMITS_BY_KIND, "event_type")
    return f.select(F.to_date("window_start").alias("window_day"), "user_id", "event_type", "n")


# --------------------------------------------------------------------------
# Training and plug-in scoring (rows-only checks)
# --------------------------------------------------------------------------

@register("train_and_score", None)
def q_train_and_score(spark, sf_dir):
    """E5 + E6: train on the 70% split of the labelled documents, pick the
    regularisation on the validation split, score the test split."""
    from ..operators.training import score_with_pipeline, train_classifier
    from ..session import materialize
    sp = materialize(D.stratified_split(labelled_frame(spark, sf_dir), "doc_id", "label"))
    model, _rp, _f1 = train_classifier(sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "val"))
    test = sp.filter(F.col("split") == "test").select("doc_id", "text", "label")
    s = S.score_probs(score_with_pipeline(model, test), "probs")
    return s.select("doc_id", F.col("label").alias("y_true"), F.col("ml_label_id").alias("y_pred"), "ml_confidence")


def _length_model():
    """A stand-in external model, loaded once per task: logits from simple
    text statistics computed with numpy over the Arrow batch."""
    import numpy as np

    def predict(texts):
        n = texts.str.len().to_numpy(dtype="float64")
        words = texts.str.count(" ").to_numpy(dtype="float64") + 1.0
        digits = texts.str.count("[0-9]").to_numpy(dtype="float64")
        return np.stack([np.log1p(n), np.log1p(words), digits / 10.0, np.sqrt(n) / 50.0], axis=1)
    return predict


@register("model_scoring_plugin", None)
def q_model_scoring_plugin(spark, sf_dir):
    """E6 plug-in point: any Python model over Arrow batches, then native
    softmax, fallback and fusion."""
    d = seeded_corpus(spark, sf_dir)
    scored = S.score_with_model(d, "text", _length_model, 4, "probs")
    return flat_result(classify(scored))


# --------------------------------------------------------------------------
# CSV scan and the whole preparation job
# --------------------------------------------------------------------------

def _labelled_csv(spark, sf_dir) -> str:
    from ..session import scratch_path
    path = scratch_path(spark, "labelled-csv")
    lf = labelled_frame(spark, sf_dir).select("doc_id", "text", "label")
    lf.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


@register("labeled_csv_scan", f"WITH lf AS ({LABELLED_SQL}) SELECT doc_id, label, md5(text) AS text_md5 FROM lf")
def q_labeled_csv_scan(spark, sf_dir):
    """The labelled documents written as CSV (quoted, multi-line texts)
    and read back with the strict reader."""
    from ..sources.io import load_labeled_csv
    df = load_labeled_csv(spark, _labelled_csv(spark, sf_dir))
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"),
                     F.md5("text").alias("text_md5"))


@register("prepare_manifest_rows", f"""WITH lf AS ({LABELLED_SQL}),
{split_sql('lf', (0.7, 0.15, 0.15))}
SELECT count(*) AS loaded, CAST(0 AS BIGINT) AS dropped_empty_text, CAST(0 AS BIGINT) AS truncated_text_rows,
  count(*) AS after_normalize, CAST(0 AS BIGINT) AS duplicates_removed, count(*) AS after_dedupe,
  count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val,
  count(*) FILTER (WHERE split = 'test') AS test FROM sp""")
def q_prepare_manifest_rows(spark, sf_dir):
    """H3 end to end on a CSV of the labelled documents: the manifest's row
    counts."""
    from ..session import scratch_path
    from .prepare import prepare
    m = prepare(spark, _labelled_csv(spark, sf_dir), scratch_path(spark, "prepared"))
    r = m["rows"]
    cols = ["loaded", "dropped_empty_text", "truncated_text_rows", "after_normalize", "duplicates_removed",
            "after_dedupe", "train", "val", "test"]
    return spark.createDataFrame([tuple(int(r[c]) for c in cols)], ", ".join(f"{c} bigint" for c in cols))


# --------------------------------------------------------------------------
# streaming
# --------------------------------------------------------------------------

def staged_runs(spark, df, name: str, job, go: Column | None = None, batches: int = 2) -> None:
    """Feed ``job(stream)`` from a folder that gets files in two goes, with a run
    after each and a restart between.  ``go`` (0 or 1, by default a hash of the key)
    says when a row arrives; a run works its files off in so many micro-batches, each
    of a file a core at least, so that every core has rows in every micro-batch."""
    from ..streaming.jobs import folder_stream, fresh_dir
    src = fresh_dir(spark, f"{name}-arriving")
    go = F.pmod(F.xxhash64(df.columns[0]), F.lit(2)) if go is None else go
    each = spark.sparkContext.defaultParallelism
    for part in (0, 1):
        half = df.where(go == part)
        half.repartition(batches * each).write.mode("append").parquet(src)
        job(folder_stream(spark, src, df.schema, each))


def _corpus_frame(spark, sf_dir) -> DataFrame:
    return seeded_corpus(spark, sf_dir).withColumn("probs", fixture_probs(F.col("doc_id")))


def _classified_stream_dir(spark, sf_dir) -> str:
    from ..streaming.jobs import classify_stream, fresh_dir
    out, ck = fresh_dir(spark, "stream-results"), fresh_dir(spark, "stream-results-ckpt")
    staged_runs(spark, _corpus_frame(spark, sf_dir), "classify", lambda s: classify_stream(s, out, ck))
    return out


@register("stream_classify", _with(O.flat_result_select()))
def q_stream_classify(spark, sf_dir):
    """Streamed classification (files arriving in two goes, the job
    restarted between) equals the batch result."""
    return flat_result(spark.read.parquet(_classified_stream_dir(spark, sf_dir)))


EPOCH_2024 = 1_704_067_200


@register("stream_label_counts", _with(
    "CAST(epoch(date_trunc('hour', make_timestamp((CAST(" + str(EPOCH_2024) + " AS BIGINT) + doc_id * 60) * 1000000))) "
    "AS BIGINT) AS window_start, label, len(review_reasons) > 0 AS requires_human_review, count(*) AS n",
    tail="GROUP BY ALL"))
def q_stream_label_counts(spark, sf_dir):
    """Label / review counters per 1-hour event-time window (a document's
    event time is one minute per ``doc_id`` from 2024-01-01), over the stored
    results as they arrive.  The watermark's delay covers the whole table, so
    the second run's rows are not late."""
    from ..streaming.jobs import fresh_dir, label_counts_stream, latest
    res = results_table(spark, sf_dir).select("doc_id", "label", "requires_human_review").withColumn(
        "ts", F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 60))
    out, ck = fresh_dir(spark, "stream-labelcounts"), fresh_dir(spark, "stream-labelcounts-ckpt")
    staged_runs(spark, res, "labelcounts", lambda s: label_counts_stream(s, "ts", "1 hour", "36500 days", out, ck))
    got = latest(spark, out, ["window_start", "label", "requires_human_review"])
    return got.select(F.unix_seconds("window_start").alias("window_start"), "label", "requires_human_review", "n")


@register("stream_categories", f"WITH {FAIR_CTES}\nSELECT category, total, positive FROM cat")
def q_stream_categories(spark, sf_dir):
    """Running category counts over the stored results as they arrive."""
    from ..streaming.jobs import category_counts_stream, fresh_dir, latest
    res = results_table(spark, sf_dir).select("doc_id", "label", "bias_metadata")
    out, ck = fresh_dir(spark, "stream-categories"), fresh_dir(spark, "stream-categories-ckpt")
    staged_runs(spark, res, "categories", lambda s: category_counts_stream(s, out, ck))
    return latest(spark, out, ["category"])


@register("stream_rate_limit", REGISTRY["rate_limit_flags"][1])
def q_stream_rate_limit(spark, sf_dir):
    """T5: per-user daily request counts as a stream; flags on the latest."""
    from ..functions.time import as_utc_instant, utc_date
    from ..streaming.jobs import fresh_dir, latest, rate_limit_stream
    ev = read_table(spark, sf_dir, "events")
    ev = ev.withColumn("ts", as_utc_instant(F.col("ts"), ev.schema["ts"].dataType))
    out, ck = fresh_dir(spark, "stream-ratelimit"), fresh_dir(spark, "stream-ratelimit-ckpt")
    staged_runs(spark, ev.select("event_id", "user_id", "ts"), "ratelimit",
                lambda s: rate_limit_stream(s, "user_id", "ts", "1 day", "36500 days", out, ck))
    res = M.over_limit(latest(spark, out, ["window_start", "user_id"]), RATE_LIMIT_PER_DAY)
    return res.select(utc_date(F.col("window_start")).alias("window_day"), "user_id", "n")


@register("stream_late_rows", """WITH e AS (SELECT event_id % 2 AS go, event_type, epoch_us(ts) AS us,
  epoch_us(date_trunc('hour', ts)) // 1000000 AS window_start FROM events),
m AS (SELECT max(us) - 86400000000 AS mark FROM e WHERE go = 0),
p AS (SELECT e.*, go = 1 AND (window_start + 3600) * 1000000 <= mark AS late FROM e, m)
SELECT window_start, event_type, count(*) FILTER (WHERE NOT late) AS n_counted, count(*) FILTER (WHERE late) AS n_late
FROM p GROUP BY ALL""")
def q_stream_late_rows(spark, sf_dir):
    """T5 / T2 with a watermark of one day: the odd events arrive after the even
    ones, so most are late.  Hourly counts whose state has expired, and the late
    rows kept aside, add up to the input."""
    from ..functions.time import as_utc_instant
    from ..streaming.jobs import fresh_dir, latest, rate_limit_stream
    ev = read_table(spark, sf_dir, "events")
    ev = ev.withColumn("ts", as_utc_instant(F.col("ts"), ev.schema["ts"].dataType)).select("event_id", "user_id", "event_type", "ts")
    out, late, ck = (fresh_dir(spark, f"stream-late-{n}") for n in ("counts", "rows", "ckpt"))
    staged_runs(spark, ev, "late", lambda s: rate_limit_stream(s, "user_id", "ts", "1 hour", "1 day", out, ck, "event_type", late),
                go=F.col("event_id") % 2, batches=1)
    counts = latest(spark, out, ["window_start", "user_id", "event_type"])
    zero = F.lit(0).cast("long")
    both = counts.select("window_start", "event_type", F.col("n").alias("n_counted"), zero.alias("n_late")).unionByName(
        spark.read.parquet(late).select(F.window("ts", "1 hour")["start"].alias("window_start"), "event_type",
                                        zero.alias("n_counted"), F.lit(1).cast("long").alias("n_late")))
    return both.groupBy(F.unix_seconds("window_start").alias("window_start"), "event_type").agg(
        F.sum("n_counted").alias("n_counted"), F.sum("n_late").alias("n_late"))


@register("stream_ingest", f"""WITH f AS (SELECT doc_id, {FAULTY_SQL} AS t FROM documents)
SELECT doc_id, {_reason_sql('t')} AS reject_reason,
  CASE WHEN {_reason_sql('t')} IS NULL THEN md5({O.ustrip_sql('t')}) END AS text_md5 FROM f""")
def q_stream_ingest(spark, sf_dir):
    """Normalised valid rows and rejects written from each micro-batch."""
    from ..streaming.jobs import fresh_dir, ingest_stream
    valid, rej, ck = (fresh_dir(spark, f"stream-{n}") for n in ("valid", "rejects", "ingest-ckpt"))
    staged_runs(spark, faulty_documents(spark, sf_dir), "ingest", lambda s: ingest_stream(s, "text", valid, rej, ck))
    none = F.lit(None).cast("string")
    v = spark.read.parquet(valid).select("doc_id", none.alias("reject_reason"), F.md5("text").alias("text_md5"))
    return v.unionByName(spark.read.parquet(rej).select("doc_id", "reject_reason", none.alias("text_md5")))


# --------------------------------------------------------------------------
# Sources and sinks written and read back
# --------------------------------------------------------------------------

def _written(spark, name: str, df: DataFrame) -> str:
    """Lines of text (a column ``value``) as files in the shared folder."""
    from ..streaming.jobs import fresh_dir
    path = fresh_dir(spark, name)
    df.select("value").write.text(path)
    return path


def _json_object(kind, broken: str):
    """A document's text as a JSON object, under one of two names; every
    twentieth is ``broken`` and another has neither."""
    body = F.to_json(F.struct(F.col("text").alias("text")))
    return (F.when(kind == 1, F.to_json(F.struct(F.col("text").alias("content")))).when(kind == 2, F.lit(broken))
            .when(kind == 3, F.lit('{"other": 1}')).otherwise(body))


def _json_lines(spark, sf_dir) -> str:
    d = read_table(spark, sf_dir, "documents")
    return _written(spark, "jsonl", d.select(_json_object(F.col("doc_id") % 20, '{"text": broken').alias("value")))


_JSON_SQL = """src AS (SELECT doc_id, doc_id % 20 AS kind, text FROM documents),
it AS (SELECT doc_id, CASE WHEN kind = 2 THEN NULL WHEN kind = 3 THEN '' ELSE text END AS text, kind = 2 AS malformed FROM src)"""


@register("read_jsonl", f"""WITH {_JSON_SQL}
SELECT md5(text) AS text_md5, malformed, count(*) AS n FROM it GROUP BY 1, 2""")
def q_read_jsonl(spark, sf_dir):
    """Whole texts as JSON Lines, with contents, broken lines and other
    objects; a broken line is kept as ``malformed``."""
    from ..sources.io import read_texts
    got = read_texts(spark, _json_lines(spark, sf_dir), ".jsonl")
    return got.groupBy(F.md5("text").alias("text_md5"), F.col("malformed").isNotNull().alias("malformed")).agg(
        F.count(F.lit(1)).alias("n"))


@register("classify_file_rejects", f"""WITH {_JSON_SQL}
SELECT reason AS reject_reason, count(*) AS n FROM (SELECT CASE WHEN malformed THEN 'malformed' WHEN text = '' THEN 'empty'
  WHEN {O.ustrip_sql('text')} = '' THEN 'blank' ELSE 'classified' END AS reason FROM it) GROUP BY 1""")
def q_classify_file_rejects(spark, sf_dir):
    """I4: a file's items are either classified or in the rejects, none lost."""
    from ..streaming.jobs import fresh_dir
    from .classify import classify_file
    out, rej = fresh_dir(spark, "file-results"), fresh_dir(spark, "file-rejects")
    classify_file(spark, _json_lines(spark, sf_dir), out, ".jsonl", rejects_path=rej)
    done = spark.read.json(out).select(F.lit("classified").alias("reject_reason"))
    return done.unionByName(spark.read.json(rej).select("reject_reason")).groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("n"))


@register("read_json_array", f"""WITH {_JSON_SQL}
SELECT md5(text) AS text_md5, malformed, count(*) AS n FROM it GROUP BY 1, 2""")
def q_read_json_array(spark, sf_dir):
    """Files that each hold one JSON array of whole texts; an element that
    is no object is one malformed item."""
    from ..sources.io import read_texts
    from ..streaming.jobs import fresh_dir
    d = read_table(spark, sf_dir, "documents")
    path = fresh_dir(spark, "json-array")
    # Groups of about 250 documents; an array a row, and a row a file.
    group = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-d.count() // 250))))
    items = F.array_join(F.collect_list(_json_object(F.col("doc_id") % 20, "17")), ",")
    (d.groupBy(group).agg(F.concat(F.lit("["), items, F.lit("]")).alias("value")).select("value")
     .write.option("maxRecordsPerFile", 1).text(path))
    got = read_texts(spark, path, ".json")
    return got.groupBy(F.md5("text").alias("text_md5"), F.col("malformed").isNotNull().alias("malformed")).agg(
        F.count(F.lit(1)).alias("n"))


_LINE = r"regexp_replace(text, '[\r\n]+', ' ', 'g')"


@register("read_text_lines", f"""SELECT md5({O.ustrip_sql(_LINE)}) AS text_md5, count(*) AS n FROM documents
WHERE {O.ustrip_sql(_LINE)} <> '' GROUP BY 1""")
def q_read_text_lines(spark, sf_dir):
    """One stripped text a line, blank lines dropped; of the whole texts
    only the line breaks are replaced."""
    from ..sources.io import read_texts
    d = read_table(spark, sf_dir, "documents")
    path = _written(spark, "lines", d.select(F.regexp_replace("text", "[\r\n]+", " ").alias("value")))
    return read_texts(spark, path, ".txt").groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


#: Documents a file where queries write files whose content SQL must know.
FILE_DOCS = 256


def _text_files(spark, sf_dir) -> str:
    """Whole texts, a line break after each, as files of ``FILE_DOCS``
    neighbouring ids in order: as many files as the table needs."""
    from ..streaming.jobs import fresh_dir
    path = fresh_dir(spark, "text files")
    d = read_table(spark, sf_dir, "documents").withColumn("part", F.floor(F.col("doc_id") / FILE_DOCS).cast("int"))
    d.select("part", "doc_id", "text").repartition("part").sortWithinPartitions("part", "doc_id").select(
        "part", F.col("text").alias("value")).write.partitionBy("part").text(path)
    return path


_WHOLE_BYTES = 700_000
_TREE = ("list_transform(range(0, CAST(ceil(len(h) / 4096.0) AS BIGINT)), "
         "lambda k: sha256(array_to_string(h[k * 4096 + 1:(k + 1) * 4096], '')))")


@register("source_digest", f"""WITH RECURSIVE f AS (SELECT CAST(doc_id // {FILE_DOCS} AS INTEGER) AS part, string_agg(text || chr(10), '' ORDER BY doc_id) AS body
  FROM documents GROUP BY 1),
l AS (SELECT part, CAST(strlen(body) AS BIGINT) AS size_bytes, sha256(body) AS whole, list_transform(string_split(body, chr(10))[:-2], lambda x: sha256(x)) AS h FROM f),
t AS (SELECT part, len(h) AS n, h FROM l UNION ALL SELECT part, n, {_TREE} FROM t WHERE len(h) > 1)
SELECT part, size_bytes, CASE WHEN size_bytes > {_WHOLE_BYTES} THEN 'lines' ELSE 'file' END AS kind,
  CASE WHEN size_bytes > {_WHOLE_BYTES} THEN sha256(size_bytes || ':' || n || ':' || t.h[1]) ELSE whole END AS sha256
FROM l JOIN t USING (part) WHERE len(t.h) = 1""")
def q_source_digest(spark, sf_dir):
    """S12 over many files of whole texts: their own digests, and those of the
    larger ones (here from ``_WHOLE_BYTES`` on) by the tree of their lines."""
    from ..sources.io import file_digests
    got = file_digests(spark, _text_files(spark, sf_dir), whole_file_bytes=_WHOLE_BYTES)
    return got.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part"), "size_bytes", "kind", "sha256")


@register("file_item_numbers", f"""WITH s AS (SELECT doc_id, doc_id // {FILE_DOCS} AS part, {O.ustrip_sql(_LINE)} AS t FROM documents),
i AS (SELECT t, row_number() OVER (ORDER BY CAST(part AS VARCHAR), doc_id) - 1 AS item_idx FROM s WHERE t <> '')
SELECT item_idx, md5(t) AS text_md5, 'req_chunk_' || item_idx // 8 || '_' || item_idx % 8 AS request_id FROM i""")
def q_file_item_numbers(spark, sf_dir):
    """I3 on files: items numbered from 0 in input order (files by path, then
    lines), and the chunk ids that follow from it."""
    from ..sources.io import read_texts
    from ..streaming.jobs import fresh_dir
    path = fresh_dir(spark, "numbered")
    d = read_table(spark, sf_dir, "documents").withColumn("part", F.floor(F.col("doc_id") / FILE_DOCS).cast("int"))
    d.repartition("part").sortWithinPartitions("part", "doc_id").select(
        "part", F.regexp_replace("text", "[\r\n]+", " ").alias("value")).write.partitionBy("part").text(path)
    items = read_texts(spark, path, ".txt").withColumn("batch_id", F.lit("req"))
    return chunk_request_ids(items).select("item_idx", F.md5("text").alias("text_md5"), "request_id")


@register("json_sink", _with("doc_id, label, confidence, risk_score"))
def q_json_sink(spark, sf_dir):
    """Results written as JSON and read back."""
    from ..sources.io import write_json
    from ..streaming.jobs import fresh_dir
    path = fresh_dir(spark, "json-sink")
    write_json(classified_corpus(spark, sf_dir).select("doc_id", "label", "confidence", "risk_score"), path)
    return spark.read.schema("doc_id long, label string, confidence double, risk_score int").json(path)


@register("csv_sink", _with("doc_id, label, confidence, risk_score, array_to_string(rule_terms, ', ') AS flagged_terms, reasoning"))
def q_csv_sink(spark, sf_dir):
    """The CSV result file written and read back."""
    from ..sources.io import write_results_csv
    from ..streaming.jobs import fresh_dir
    path = fresh_dir(spark, "csv-sink")
    write_results_csv(classified_corpus(spark, sf_dir), path)
    got = spark.read.option("header", True).option("escape", '"').schema(
        "doc_id long, label string, confidence double, risk_score int, flagged_terms string, reasoning string").csv(path)
    return got.fillna("", ["flagged_terms"])


@register("append_logs", _with("doc_id, CAST(2 AS BIGINT) AS n_results, CAST(2 AS BIGINT) AS n_audits, label"))
def q_append_logs(spark, sf_dir):
    """Two runs append to the result and audit logs, and one of them is
    repeated: each counts once.  What they log is classified once."""
    from ..streaming.jobs import fresh_dir
    from .classify import read_log, stored_results, write_logs
    path = fresh_dir(spark, "logs")
    res = stored_results(classified_corpus(spark, sf_dir))
    for run in ("first", "second", "second"):
        write_logs(res, path, "doc_id", run)
    r = read_log(spark, path, "result_log").groupBy("doc_id", "label").agg(F.count("audit_id").alias("n_results"))
    a = read_log(spark, path, "audit_log").groupBy("doc_id").agg(F.count("request_id").alias("n_audits"))
    return r.join(a, "doc_id").select("doc_id", "n_results", "n_audits", "label")


@register("lexicon_file", _with("doc_id, array_to_string(rule_terms, ', ') AS rule_terms, rule_risk", RULED_CTES, "ru2"))
def q_lexicon_file(spark, sf_dir):
    """The rules written as a table, read back, and applied."""
    from ..streaming.jobs import fresh_dir
    path = fresh_dir(spark, "rules")
    R.rules_frame(spark).write.parquet(path)
    lexicon = R.lexicon_from_frame(spark.read.parquet(path))
    r = R.match_rules(cleaned_corpus(spark, sf_dir), "cleaned", lexicon)
    return r.select("doc_id", F.array_join("rule_terms", ", ").alias("rule_terms"), "rule_risk")


@register("weights_normalised", _with("doc_id, risk_score, label"))
def q_weights_normalised(spark, sf_dir):
    """F1: weights of 3 and 7 act like 0.3 and 0.7."""
    from dataclasses import replace
    r = classified_corpus(spark, sf_dir, replace(DEFAULT_FUSION, rule_weight=3.0, ml_weight=7.0))
    return r.select("doc_id", "risk_score", "label")


@register("input_order", _with("doc_id, label", tail="ORDER BY source, doc_id"))
def q_input_order(spark, sf_dir):
    """Results in the order of (batch, item)."""
    from .classify import in_input_order
    return in_input_order(classified_corpus(spark, sf_dir), "source", "doc_id").select("doc_id", "label")


# --------------------------------------------------------------------------
# Faults that must not make rows vanish
# --------------------------------------------------------------------------

_DIRTY_SQL = PAIRS_SQL.replace("SELECT CAST(2 * l.toxic + 1 - l.quality AS INTEGER) AS y_true, f.ml_label_id AS y_pred",
    "SELECT CASE WHEN l.doc_id % 10 = 3 THEN 7 WHEN l.doc_id % 10 = 4 THEN NULL ELSE CAST(2 * l.toxic + 1 - l.quality AS INTEGER) END AS y_true, "
    "CASE WHEN l.doc_id % 10 = 5 THEN 9 ELSE f.ml_label_id END AS y_pred")


def dirty_pairs(spark, sf_dir) -> DataFrame:
    """Truth and prediction with values outside the classes, and nulls."""
    k = F.col("doc_id") % 10
    return eval_pairs(spark, sf_dir).select(
        F.when(k == 3, F.lit(7)).when(k == 4, F.lit(None).cast("int")).otherwise(F.col("y_true")).alias("y_true"),
        F.when(k == 5, F.lit(9)).otherwise(F.col("y_pred")).alias("y_pred"))


@register("eval_metrics_dirty", _DIRTY_SQL + f"""
SELECT {_r6s('CAST(sum(n) FILTER (WHERE y_true = y_pred) AS DOUBLE) / CAST(sum(n) AS DOUBLE)')} AS accuracy, CAST(sum(n) AS BIGINT) AS support FROM cm""")
def q_eval_metrics_dirty(spark, sf_dir):
    """G13 counts every pair, whatever its labels."""
    return M.eval_metrics(dirty_pairs(spark, sf_dir), 4).select("accuracy", "support")


@register("confusion_dense_dirty", _DIRTY_SQL + """,
b AS (SELECT CASE WHEN y_true BETWEEN 0 AND 3 THEN y_true ELSE -1 END AS t, CASE WHEN y_pred BETWEEN 0 AND 3 THEN y_pred ELSE -1 END AS p, n FROM cm
  UNION ALL SELECT label_id, -1, 0 FROM dim)
SELECT t AS y_true, """ + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE p = {i}), 0) AS BIGINT) AS p{i}" for i in range(4)) + """,
  CAST(coalesce(sum(n) FILTER (WHERE p = -1), 0) AS BIGINT) AS p_other FROM b GROUP BY t""")
def q_confusion_dense_dirty(spark, sf_dir):
    return M.confusion_dense(dirty_pairs(spark, sf_dir), 4)


@register("counters_any_label", """SELECT 'requests_total' AS metric, '' AS key, CAST(count(*) AS BIGINT) AS value FROM documents
UNION ALL SELECT 'label_total', coalesce(CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END, 'unknown'), count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'review_total', CASE WHEN n_chars > 1000 THEN 'review_required' ELSE 'no_review' END, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'errors_total', source, count(*) FROM documents WHERE n_chars < 500 GROUP BY 2""")
def q_counters_any_label(spark, sf_dir):
    """G9 with labels outside the fixed four, null labels, and errors."""
    d = read_table(spark, sf_dir, "documents")
    res = d.select(F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("label"), (F.col("n_chars") > 1000).alias("requires_human_review"))
    return M.counters(res, rejects=d.where("n_chars < 500").select(F.col("source").alias("reject_reason")))


@register("bad_label_values", f"""WITH {FRAME_FAULT_SQL}
SELECT CASE WHEN doc_id % 7 = 0 THEN 'abc' ELSE CAST(label AS VARCHAR) END AS value, count(*) AS n FROM lf
WHERE doc_id % 7 = 0 OR (label IS NOT NULL AND (label <> floor(label) OR label < 0 OR label >= 4)) GROUP BY 1""")
def q_bad_label_values(spark, sf_dir):
    """Every offending label value, text among them, with its count."""
    k = F.col("doc_id")
    lf = faulty_labels(spark, sf_dir).withColumn("label", F.when(k % 7 == 0, F.lit("abc")).otherwise(F.col("label").cast("string")))
    return V.bad_label_values(lf, 4)


@register("reject_strict_batches", f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'large' ELSE source END AS batch,
  {FAULTY_SQL} AS t FROM documents),
n AS (SELECT batch, count(*) AS c FROM f GROUP BY batch)
SELECT f.doc_id, CASE WHEN f.batch IS NULL THEN 'no_batch' WHEN n.c > 100 THEN 'batch_too_large' ELSE {_strict_sql('t')} END AS reject_reason
FROM f LEFT JOIN n ON f.batch = n.batch""")
def q_reject_strict_batches(spark, sf_dir):
    """B3 with items that have no batch, and a batch over the limit."""
    k = F.col("doc_id")
    d = faulty_documents(spark, sf_dir).withColumn(
        "batch", F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 2 == 0, F.lit("large")).otherwise(F.col("source")))
    return V.reject_strict(d, "batch").select("doc_id", "reject_reason")


@register("batch_verdicts_small", f"""WITH f AS (SELECT doc_id, source, {FAULTY_SQL} AS t FROM documents)
SELECT source, CASE WHEN count(*) > 49 THEN 'batch_too_large' WHEN min(CASE WHEN t IS NULL OR t = '' THEN doc_id END) IS NOT NULL
  THEN 'empty_item' END AS verdict FROM f GROUP BY source""")
def q_batch_verdicts_small(spark, sf_dir):
    """B2 with a limit that batches exceed."""
    return V.batch_verdicts(faulty_documents(spark, sf_dir), "source", "doc_id", max_batch=49).select("source", "verdict")


@register("ingest_rows_whole", f"""WITH {INGEST_CTE}
SELECT doc_id, CAST(length(t) AS INTEGER) AS text_chars, md5(t) AS text_md5 FROM g WHERE length(t) > 0""")
def q_ingest_rows_whole(spark, sf_dir):
    """B6 without truncation, its default."""
    d = read_table(spark, sf_dir, "documents")
    rows, _ = D.normalize(d.withColumn("text", _ingest_text(F.col("text"), F.col("doc_id"))), "text")
    return rows.select("doc_id", F.length("text").alias("text_chars"), F.md5("text").alias("text_md5"))


@register("preprocess", f"""WITH src AS ({O.corpus_sql()}),
cl AS (SELECT doc_id, text, {O.clean_sql('text')} AS cleaned FROM src)
SELECT doc_id, md5(text) AS original_md5, md5(cleaned) AS cleaned_md5, CAST(len({O.tokens_sql('cleaned')}) AS INTEGER) AS token_count,
  md5(array_to_string({O.tokens_sql('cleaned')}, '|')) AS tokens_md5 FROM cl""")
def q_preprocess(spark, sf_dir):
    """Original, cleaned, tokens and their count."""
    p = preprocess(seeded_corpus(spark, sf_dir))
    return p.select("doc_id", F.md5("pre.original").alias("original_md5"), F.md5("pre.cleaned").alias("cleaned_md5"),
                    "pre.token_count", F.md5(F.array_join("pre.tokens", "|")).alias("tokens_md5"))


@register("classify_raw_fields", _with(
    "doc_id, cleaned, CAST(len(" + O.tokens_sql("cleaned") + ") AS INTEGER) AS token_count, rule_risk, rule_flagged AS flagged, "
    "has_high_risk, array_to_string(rule_terms, '|') AS terms, ml_label_id AS label_id"))
def q_classify_raw_fields(spark, sf_dir):
    """The nested raw view, field by field."""
    r = raw_view(classified_corpus(spark, sf_dir))
    return r.select("doc_id", "raw.preprocessed.cleaned", "raw.preprocessed.token_count",
                    F.col("raw.rule_result.risk_score").alias("rule_risk"), "raw.rule_result.flagged",
                    F.col("raw.rule_result.has_high_risk_terms").alias("has_high_risk"),
                    F.array_join("raw.rule_result.matched_terms", "|").alias("terms"),
                    F.col("raw.ml_result.label_id").alias("label_id"))


@register("prepare_rows", f"""WITH lf0 AS ({LABELLED_SQL}),
lf1 AS (SELECT CASE WHEN doc_id % 9 = 0 THEN ' ' WHEN doc_id % 9 = 1 THEN '  ' || text ELSE text END AS text, label FROM lf0),
rows_in AS (SELECT * FROM lf1 UNION ALL SELECT * FROM lf1 WHERE label = 1),
k AS (SELECT sha256(CAST(length(text) AS VARCHAR) || ':' || text || '1:' || CAST(label AS VARCHAR)) AS doc_id,
  {O.ustrip_sql('text')} AS t, label FROM rows_in),
d AS (SELECT min(doc_id) AS doc_id FROM k WHERE length(t) > 0 GROUP BY t),
lf AS (SELECT DISTINCT k.doc_id, k.t AS text, k.label FROM d JOIN k USING (doc_id)),
{split_sql('lf', (0.7, 0.15, 0.15))}
SELECT md5(text) AS text_md5, label, split FROM sp""")
def q_prepare_rows(spark, sf_dir):
    """H3 row by row: the split of every kept row, from a CSV with blank texts,
    padded ones and duplicates."""
    from ..sources.io import read_splits
    from ..streaming.jobs import fresh_dir
    from .prepare import PrepareOptions, prepare
    k = F.col("doc_id")
    lf = labelled_frame(spark, sf_dir).select(
        F.when(k % 9 == 0, F.lit(" ")).when(k % 9 == 1, F.concat(F.lit("  "), F.col("text"))).otherwise(F.col("text")).alias("text"), "label")
    path = fresh_dir(spark, "prepare-csv")
    (lf.unionByName(lf.where("label = 1")).write.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    m = prepare(spark, path, fresh_dir(spark, "prepare-out"), PrepareOptions(remove_duplicates=True))
    return read_splits(spark, m["splits"]).select(F.md5("text").alias("text_md5"), F.col("label").cast("int").alias("label"), "split")


@register("evaluate_saved_model", None)
def q_evaluate_saved_model(spark, sf_dir):
    """Train on whole texts, save, load, score the test split,
    store the predictions, report on them."""
    from ..operators.training import evaluate_classifier, load_classifier, save_classifier, train_classifier
    from ..session import materialize
    from ..streaming.jobs import fresh_dir
    sp = materialize(D.stratified_split(labelled_frame(spark, sf_dir), "doc_id", "label"))
    model, _rp, _f1 = train_classifier(sp.filter("split = 'train'"), sp.filter("split = 'val'"))
    path = fresh_dir(spark, "model")
    save_classifier(model, path)
    _pairs, _metrics, report = evaluate_classifier(load_classifier(path), sp.filter("split = 'test'"), fresh_dir(spark, "predictions"))
    return report
