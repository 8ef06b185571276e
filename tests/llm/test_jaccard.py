"""The Jaccard join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import brute, cases
from tidepool.llm import jaccard_join

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")
COLUMNS = ("doc_id", "n_shingles", "component_id")


def edited(seed: int = 3):
    """Families of near copies around the threshold, with chains, in several sizes."""
    rng = random.Random(seed)
    rows, doc = [], 0
    for size in (6, 12, 22, 40, 90, 260):
        for _ in range(6):
            words = [f"v{rng.randrange(4000)}" for _ in range(size)]
            for _ in range(9):
                rows.append((doc, " ".join(words)))
                doc += rng.randrange(1, 4)
                for _ in range(rng.choice([0, 1, 1, 1 + size // 90, size // 40])):
                    words[rng.randrange(len(words))] = f"v{rng.randrange(4000)}"
                if rng.random() < 0.3:
                    words.append(f"v{rng.randrange(4000)}")
    rng.shuffle(rows)
    return rows


def test_all_pairs(spark):
    rows = edited() + [(100_000 + d, t) for d, t in cases.ODD]
    docs = cases.documents(spark, rows)
    want = cases.ordered(brute.components(rows))
    assert len({c for _, _, c in want}) < len(rows) - 100
    assert cases.rows(jaccard_join.join(docs), *COLUMNS) == want


def test_neighbourhoods(spark):
    """The same result when every group relies on one-deletion neighbourhoods."""
    rows = edited(4)
    bands = jaccard_join.Bands(jaccard_join.PERCENT)
    need = bands.exact - bands.spare + 2 * bands.near
    bands.exact, bands.near, bands.spare = need % 2, need // 2, 0 * need
    assert bands.near.max() > 0
    assert cases.rows(jaccard_join.join(cases.documents(spark, rows), bands=bands), *COLUMNS) == cases.ordered(brute.components(rows))


def test_costs():
    few, many = jaccard_join.allocation(20, 200, 10**4), jaccard_join.allocation(20, 50, 10**4)
    assert few[1] > 0 and few[2] == 0  # full segments: all are kept
    assert many == (41, 0, 20)  # thin ones: the rarest of twice as many
    for most in range(1, 60):
        for n in (0, 10**4, 10**12):
            exact, near, spare = jaccard_join.allocation(most, most * 9.5, n)
            assert exact - spare + 2 * near >= most + 1
    # At 80 percent and a moderate corpus, the rarest signatures are the cheaper index.
    bands = jaccard_join.Bands(80, dict.fromkeys(range(60), 20_000))
    assert bands.near[bands.of(np.array([272]))[0]] == 0
    bands = jaccard_join.Bands(90)
    sizes = np.arange(1, 5000)
    group = bands.of(sizes)
    assert (np.asarray(bands.edges)[group] <= sizes).all() and (sizes < np.asarray(bands.edges)[group + 1]).all()
    for percent in (80, 94, 97, 99):
        bands = jaccard_join.Bands(percent)
        assert len(bands.edges) <= 1 << bands.group_bits


def test_sample(spark):
    docs = cases.sample(spark)
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert cases.rows(jaccard_join.join(docs), *COLUMNS) == cases.ordered(brute.components(pairs))


def test_null_and_repeated_ids(spark):
    p = cases.PASSAGE
    docs = cases.documents(spark, [(None, p), (5, p), (5, p), (5, "other words here"), (6, p + " x"), (None, None), (None, "alone it is")])
    assert cases.rows(jaccard_join.join(docs), *COLUMNS) == cases.ordered(
        [(None, 58, 5), (5, 58, 5), (5, 58, 5), (5, 1, 5), (6, 59, 5), (None, 0, None), (None, 1, None)])


def test_empty(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_multiply_nothing(spark):
    """All texts under one id, or none, give the same sets and links as under ids of their own."""
    rows = edited(6)
    with_ids = {(r.n_shingles, r.text_hash) for r in jaccard_join.named(cases.documents(spark, rows)).collect()}
    none = jaccard_join.named(cases.documents(spark, [(None, t) for _, t in rows])).collect()
    one = jaccard_join.named(cases.documents(spark, [(7, t) for _, t in rows])).collect()
    assert {(r.n_shingles, r.text_hash) for r in none} == with_ids and len(none) == len(one) == len(rows)
    assert {r.component_id for r in none} == {None} and {r.component_id for r in one} == {7}


def family(n):
    """Texts of 60 words that share all but their own 8: alike, but not similar enough to be linked, and each third one with a copy that is."""
    common = [f"w{i}" for i in range(52)]
    texts = [" ".join(common + [f"u{i}x{j}" for j in range(8)]) for i in range(n)]
    return list(enumerate(texts + [t + " more" for t in texts[::3]]))


def test_a_large_family_is_not_copied_for_each_block(spark, monkeypatch):
    from tidepool.llm import jaccard_join, set_groups

    seen, compared = [], set_groups.compared
    monkeypatch.setattr(set_groups, "compared", lambda cells, *a: seen.append(cells.count()) or compared(cells, *a))
    sets = spark.range(600).selectExpr("id", "1L size", "0L key")
    tokens = spark.range(600).selectExpr("id", "unhex(lpad(hex(id), 16, '0')) tokens")
    assert set_groups.linked(tokens, sets.select("id", "size"), sets.select("key", "id"), 90, jaccard_join.components).count() == 0
    assert seen == [600, 600]  # each set once a round; in cells of 256 sets the second round had 3,600


@pytest.mark.parametrize("block", [7, 256])
def test_blocks_of_a_cell_lose_no_link(spark, monkeypatch, block):
    from tidepool.llm import set_groups

    monkeypatch.setattr(set_groups, "BLOCK_SETS", block)
    rows = family(45)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i < 45 else 3 * (i - 45) for i, _ in rows}
