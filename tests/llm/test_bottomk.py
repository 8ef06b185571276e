"""Bottom-k near-duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import brute, cases
from tidepool.llm import bottomk

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")
COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def components(docs, k=4, percent=80):
    sets = []
    for doc, text in docs:
        w = brute.SPACED.findall(brute.lower(text))
        sets.append((doc, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    label = [d for d, _ in sets]
    links = []
    for i, (_, s) in enumerate(sets):
        for j, (_, t) in enumerate(sets[:i]):
            if s and t and percent * max(len(s), len(t)) <= 100 * min(len(s), len(t)):
                same = len(s & t)
                if 100 * same >= percent * (len(s) + len(t) - same):
                    links.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min((x for x in (label[i], label[j]) if x is not None), default=None)
            if (label[i], label[j]) != (low, low):
                label[i] = label[j] = low
                changed = True
    return cases.ordered([(d, len(s), c, c is None or d == c) for (d, s), c in zip(sets, label)])


def edited(seed=5):
    """Families of copies around the threshold, from a few words to several sketches long, and a passage that many share."""
    rng = random.Random(seed)
    rows, doc = [], 0
    passage = [f"p{i}" for i in range(70)]
    for size in (5, 9, 20, 60, 100, 130, 400, 900):
        for family in range(5):
            words = [f"v{rng.randrange(5000)}" for _ in range(size)]
            for _ in range(9):
                rows.append((doc, " ".join(words + (passage if family == 2 else []))))
                doc += rng.randrange(1, 4)
                for _ in range(rng.choice([0, 1, 1, 1 + size // 60, size // 25])):
                    words[rng.randrange(len(words))] = f"v{rng.randrange(5000)}"
                if rng.random() < 0.3:
                    words.append(f"v{rng.randrange(5000)}")
    rng.shuffle(rows)
    return rows


def hot_family(seed=9, n=160):
    """Copies of one text whose similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"h{i}" for i in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("cells", [{}, {"cell_sets": 5}, {"cell_tokens": 700}])
def test_all_pairs(spark, cells):
    rows = edited() + hot_family(n=60) + [(100_000 + d, t) for d, t in cases.ODD]
    rows = [(10_000 + i if str(t).startswith("h") else d, t) for i, (d, t) in enumerate(rows)]
    want = components(rows)
    assert sum(not r[3] for r in want) > 100
    assert cases.rows(bottomk.judge(cases.documents(spark, rows), **cells), *COLUMNS) == want


def test_hot_family(spark):
    rows = hot_family()
    want = components(rows)
    assert 1 < sum(r[3] for r in want) < len(rows)
    assert cases.rows(bottomk.judge(cases.documents(spark, rows), cell_sets=16), *COLUMNS) == want


def test_sample(spark):
    docs = cases.sample(spark)
    assert cases.rows(bottomk.judge(docs), *COLUMNS) == components([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_null_and_repeated_ids(spark):
    p = cases.PASSAGE
    docs = [(None, p), (5, p), (5, p), (5, "other words here"), (6, p + " x"), (None, None), (None, "alone it is"), (None, "Alone it is")]
    assert cases.rows(bottomk.judge(cases.documents(spark, docs)), *COLUMNS) == components(docs)


def test_bound():
    """The least overlap is one that a sample of similar sets practically never misses, and is not trivial."""
    least = bottomk.least_shared(96, 80)
    assert 40 <= least <= 50
    rng = np.random.default_rng(1)
    shared = rng.hypergeometric(400, 100, 96, size=200_000)
    assert shared.min() >= least
    assert bottomk.least_shared(96, 100) == 96


def test_estimate_keeps_similar_pairs():
    rng = np.random.default_rng(2)
    may, lost, passed = bottomk.estimate(96, 80), 0, 0
    xs, ys = [], []
    for i in range(300):
        both = rng.integers(0, 2**63, 400, dtype=np.uint64)
        other = rng.integers(0, 2**63, 100, dtype=np.uint64)
        xs.append(np.sort(np.concatenate([both, other[:50]])))
        ys.append(np.sort(np.concatenate([both, other[50:]])) if i % 2 else np.sort(np.concatenate([both[:100], rng.integers(0, 2**63, 300, dtype=np.uint64)])))
    keep = may(xs, ys, np.arange(300), np.arange(300))
    assert keep[1::2].all() and not keep[::2].any()


def test_empty(spark):
    assert bottomk.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
