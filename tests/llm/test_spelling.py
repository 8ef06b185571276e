"""Spelling variants against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tests.llm import cases
from tidepool.llm import spelling

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    form, near = {}, {}
    for w in n:
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if one_edit(w, v)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return cases.ordered([(w, form[w], root(w), n[w], near[w], n.get(form[w])) for w in n])


def planted(seed=7, words=260):
    """Texts of frequent words and their variants at every place, with chains of forms."""
    rng = random.Random(seed)
    letters = "abcdeàÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(words)]
    out = []
    for w in base:
        for often in ([200, 400], [20, 40, 60], [5, 6, 7])[:rng.randrange(1, 4)]:
            out += [w] * rng.choice(often)
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at + 1:]])
    rng.shuffle(out)
    return [(i, " ".join(out[k:k + 400]).title() if i % 3 else "_".join(out[k:k + 400])) for i, k in enumerate(range(0, len(out), 400))]


@pytest.mark.parametrize("cell_words", [spelling.CELL_WORDS, 7])
def test_all_pairs(spark, cell_words):
    docs = planted()
    want = brute(docs)
    assert sum(r[1] is not None for r in want) > 30 and any(r[1] != r[2] for r in want if r[1])
    assert cases.rows(spelling.variants(cases.documents(spark, docs), cell_words), *COLUMNS) == want


def test_awkward_rows(spark):
    docs = [*cases.ODD, *cases.ODD[7:9], (None, "Spelling " * 9), (None, "speling " * 40), (None, None), (5, "spelling " * 300),
            (30, "naïveté " * 10 + "naïvete " * 60 + "Éclairs éclairs " * 9), (31, "a" * 5000 + " " + "a" * 4999)] * 5
    assert cases.rows(spelling.variants(cases.documents(spark, docs)), *COLUMNS) == brute(docs)


def test_sample(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert len(want) > 300
    assert cases.rows(spelling.variants(docs), *COLUMNS) == want


def test_walk_skips_ranges():
    lists = sorted({"".join(random.Random(i).choices("abc", k=8)) for i in range(800)})
    q, w = spelling.walk(lists, np.zeros(len(lists), int), lists, np.zeros(len(lists), int))
    got = {(int(a), int(b)) for a, b in zip(q, w) if a != b}
    assert got == {(i, j) for i, u in enumerate(lists) for j, v in enumerate(lists) if one_edit(u, v)}


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
