"""Phrase and suffix dedup against plain Python."""

from __future__ import annotations

import pytest

from tests.llm import brute, cases
from tidepool.llm import anchors, phrase_dedup, suffix_dedup

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")
PHRASE = ("doc_id", "n_words", "n_removed", "kept_sha256")
SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.sample(spark)


@pytest.fixture(scope="module")
def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_phrases(docs, pairs):
    want = cases.ordered(brute.repeated_phrases(pairs))
    assert cases.rows(phrase_dedup.digests(docs), *PHRASE) == want
    assert cases.rows(phrase_dedup.digests(docs, block_bytes=2000), *PHRASE) == want  # anchors go on over many blocks


def test_suffixes(docs, pairs):
    want = cases.ordered(brute.repeated_bytes(pairs))
    assert cases.rows(suffix_dedup.digests(docs), *SUFFIX) == want
    assert cases.rows(suffix_dedup.digests(docs, block_bytes=4000), *SUFFIX) == want


def test_without_combining(docs, pairs, monkeypatch):
    monkeypatch.setattr(anchors, "COMBINE_BYTES", 1)
    monkeypatch.setattr(anchors, "LONGEST_RUN", 7)
    assert cases.rows(phrase_dedup.digests(docs), *PHRASE) == cases.ordered(brute.repeated_phrases(pairs))


def test_short_windows(docs, pairs):
    got = cases.rows(phrase_dedup.digests(docs, n=4, gram=2), *PHRASE)
    assert got == cases.ordered(brute.repeated_phrases(pairs, 4))
    got = cases.rows(suffix_dedup.digests(docs, n=30, gram=10), *SUFFIX)
    assert got == cases.ordered(brute.repeated_bytes(pairs, 30))


def test_null_and_repeated_ids(spark):
    p = cases.PASSAGE
    docs = cases.documents(spark, [(None, p), (5, p), (5, p), (6, "x " + p), (None, None)])
    got = cases.rows(phrase_dedup.digests(docs), "doc_id", "n_removed")
    assert got == cases.ordered([(None, 0), (None, 0), (5, 60), (5, 60), (6, 60)])
    alone = cases.documents(spark, [(5, p), (5, p), (7, None)])
    assert cases.rows(phrase_dedup.digests(alone), "doc_id", "n_removed") == [(5, 0), (5, 0), (7, 0)]
    assert cases.rows(suffix_dedup.digests(alone), "doc_id", "n_removed") == [(5, 0), (5, 0), (7, 0)]


def test_rows_that_share_an_id_keep_what_is_unique(spark):
    p = cases.PASSAGE
    q = " ".join(f"q{i}y{i * 5 % 11}" for i in range(60))
    for ids in ((3, 5, 5), (None, None, None), (5, 5, 5)):
        docs = cases.documents(spark, list(zip(ids, ("x " + p, p, q))))
        got = [r.n_removed for r in phrase_dedup.digests(docs).orderBy("n_words", "kept_sha256").collect()]
        assert sorted(got) == [0, 0, 60]  # one of the two keeps its passage, q is whole
        left = [r.n_removed for r in suffix_dedup.digests(docs).collect()]
        assert sorted(left) == [0, len(p), len(p)]
    twice = cases.documents(spark, [(None, p)] * 40 + [(5, q)] * 40).repartition(8)
    assert {r.n_removed for r in phrase_dedup.digests(twice, block_bytes=300).collect()} == {0}
    assert {r.n_removed for r in suffix_dedup.digests(twice).collect()} == {0}


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert phrase_dedup.digests(empty).count() == suffix_dedup.digests(empty).count() == 0
