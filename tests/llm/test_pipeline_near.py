"""The pipeline's near-duplicate stage against plain Python: five words at 0.8."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm import brute, cases
from tidepool.llm import bpe, pii, quality_rules

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")


def similarity(a, b, k=5):
    x, y = ({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()) for w in (brute.SPACED.findall(brute.lower(t)) for t in (a, b)))
    return len(x & y), len(x | y)


def components(docs):
    label = {d: d for d, _ in docs}
    links = []
    for i, (d, t) in enumerate(docs):
        for e, u in docs[:i]:
            same, either = similarity(t, u)
            if either and same and 100 * same >= 80 * either:
                links.append((d, e))
    while any(label[d] != label[e] for d, e in links):
        for d, e in links:
            label[d] = label[e] = min(label[d], label[e])
    return label


def test_copies_between_80_and_90_percent(spark):
    rng = random.Random(5)
    docs, between = [], 0
    for i in range(12):
        words = [f"w{rng.randrange(10_000)}" for _ in range(100)]
        docs.append((100 * i, " ".join(words)))
        for j in range(1, 5):  # one to four scattered changes
            copy = list(words)
            for at in rng.sample(range(5, 95, 10), j):
                copy[at] = f"new{rng.randrange(10_000)}"
            docs.append((100 * i + j, " ".join(copy)))
            same, either = similarity(docs[-1][1], " ".join(words))
            between += 80 * either <= 100 * same < 90 * either
    assert between >= 12
    want = sorted(d for d, label in components(docs).items() if d == label)
    out = corpus_pipeline.near_duplicates(spark, cases.documents(spark, docs), cases.SF)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == want


def test_run_with_five_words(spark):
    """All stages against plain Python, with the near-duplicate stage at five words and 0.8."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{cases.SF}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = [(r.doc_id, docs[r.doc_id]) for r in quality_rules.judge(spark.read.parquet(f"{cases.SF}/documents.parquet")).collect() if r.kept]
    left = [(d, docs[d]) for d, label in components(sorted(left)).items() if d == label]
    left = [(r[0], docs[r[0]]) for r in brute.decontaminate(left, items) if not r[-1]]
    coder, surrogates = bpe.load(bpe.default_vocabulary()), pii.Surrogates(pii.session_key(spark))
    want = []
    for d, text in left:
        ids = coder.encode(pii.rewritten(text, surrogates, {})[0])
        want.append((d, len(ids), brute.sha(",".join(map(str, ids)))))
    assert cases.rows(corpus_pipeline.run(spark, cases.SF), "doc_id", "n_tokens", "ids_sha256") == cases.ordered(want)
