import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from riskscope.llm import bpe

CODEC = bpe.TreeCodec.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
TINY = bpe.TreeCodec(CODEC.ranks, P.PATTERN, leaf_chars=6, leaf_bytes=2)  # joins everywhere
LIBRARY = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abeilrst'’ \n\t\r1 2é☃\U0001f600!|#.<　\x00中")), max_size=80) | st.text(max_size=60))
def test_tree_equals_the_library(text):
    want = LIBRARY.encode_ordinary(text)
    for c in (CODEC, TINY):
        assert c.encode(text) == want
        assert c.decode(want) == text.encode()


@pytest.mark.parametrize("text", ["we're", "we'll  x", "a'", "   \n\n b", "x" * 3000, "ab" * 2000, "der" * 999, " " * 700,
                                  "მე ვარ აქ " * 60, "中文 字 " * 90, "caf\u00e9 \u2003 \u00a0x " * 40, "word\n" * 300, "中" * 900,
                                  "!" * 501, "ééé" * 400, "<|endoftext|> x", "antidisestablishmentarianism" * 40])
def test_long_matches_and_seams(text):
    for c in (CODEC, TINY):
        assert c.encode(text) == LIBRARY.encode_ordinary(text)


def test_matches_equal_the_library_without_the_seam_rule():
    other = bpe.TreeCodec(CODEC.ranks, P.PATTERN, leaf_chars=6, leaf_bytes=2)
    other.standard = False
    for text in ("we're all here, they'll  say \n\n so!!  123", "x" * 500 + " y" * 300, "   a   b'll   "):
        assert other.encode(text) == LIBRARY.encode_ordinary(text)


def test_join_is_associative():
    parts = ["the", "reti", "tion", "ing"]
    enc = [list(TINY.match_tokens(p)) for p in parts]
    left = TINY.join_tokens(TINY.join_tokens(TINY.join_tokens(enc[0], enc[1]), enc[2]), enc[3])
    right = TINY.join_tokens(enc[0], TINY.join_tokens(enc[1], TINY.join_tokens(enc[2], enc[3])))
    assert left == right == list(CODEC.match_tokens("".join(parts)))


def test_query_on_odd_rows_and_real_texts(spark, make_docs, odd_texts, small_sf):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_sf}/documents.parquet").select("doc_id", "text").collect()]
    for pairs in (odd_texts, real, []):
        rows = bpe.digest(bpe.encode_documents(make_docs(pairs))).collect()
        want = []
        for i, t in pairs:
            ids = LIBRARY.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_typical_documents_are_joined(spark, small_sf, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{small_sf}/documents.parquet").select("text").collect() if r.text]
    joins, join = [], bpe.TreeCodec.join
    monkeypatch.setattr(bpe.TreeCodec, "join", lambda self, *parts: joins.append(1) or join(self, *parts))
    joined = 0
    for text in texts:
        joins.clear()
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)
        joined += bool(joins)
    assert 10 * joined > 9 * len(texts)
