"""Cross-tokenizer alignment against both tokenizers on whole texts."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tests.llm import brute, cases
from tidepool.llm import alignment

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def ends(tokens):
    out, at = [], 0
    for _, data in tokens:
        at += len(data)
        out.append(at)
    return out


def expected(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(alignment.public("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=alignment.public("piece_bpe_32k.model"))
    shown = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    hidden = [b for b in range(256) if b not in shown.values()]
    shown |= {chr(256 + i): b for i, b in enumerate(hidden)}
    word = {i: bytes(shown[c] for c in w) for w, i in a_model.get_vocab().items() if all(c in shown for c in w)}

    def piece(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc, text in docs:
        a = b = []
        if text:
            a = [(i, word[i]) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, piece(i)) for i in b_model.encode(text)]
            if any(b"".join(x for _, x in t) != (" " + text).encode() for t in (a, b)):
                a = b = []
        ea, eb = ends(a), ends(b)
        links = [(i, j) for (i, _), x in zip(a, ea) for (j, _), y in zip(b, eb) if x == y] if len(a) < 400 else None
        if links is None:
            at = {}
            for (j, _), y in zip(b, eb):
                at.setdefault(y, []).append(j)
            links = [(i, j) for (i, _), x in zip(a, ea) for j in at.get(x, ())]
        cuts = sorted(set(ea) & set(eb))
        text_of = []
        for low, high in zip([0, *cuts], cuts):
            text_of.append("|".join(",".join(str(i) for (i, _), e in zip(t, es) if low < e <= high) for t, es in ((a, ea), (b, eb))) if len(a) < 400 else None)
        if cuts and text_of[0] is None:
            sides = []
            for t, es in ((a, ea), (b, eb)):
                parts, part, left = [], [], set(cuts)
                for (i, _), e in zip(t, es):
                    part.append(str(i))
                    if e in left:
                        parts.append(",".join(part))
                        part = []
                sides.append(parts)
            text_of = ["|".join(p) for p in zip(*sides)]
        counts.update(links)
        found.append((doc, len(a), len(b), len(cuts), links, brute.sha(";".join(text_of)) if cuts else ""))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return cases.ordered([(d, na, nb, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha)
                          for d, na, nb, g, links, sha in found])


def texts(seed=11):
    rng = random.Random(seed)
    parts = ["word", " ", "  ", "\n", "é", "naïve", "日本", "🎉", " ", "　", "'s", "don't", "42", "1,000.5", "--", "<s>", "</s>", "<unk>", "<0x41>",
             "<|endoftext|>", "\t", "\r\n", "x́", "ﬁ", "Ａ", "\x00", "_", " a", " b", "A", ".", " the", " of", "​"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))) for i in range(250)]
    return rows + [(900, "a▁b"), (901, "▁"), (902, " "), (903, "  lead"), (904, "trail  "), (905, "a b c " * 3000), (906, "﻿ x y")]


def test_whole_texts(spark):
    docs = texts() + [(1000 + d, t) for d, t in cases.ODD]
    want = expected(docs)
    assert sum(r[1] > r[3] for r in want) > 100 and sum(r[1] == 0 for r in want) >= 4
    assert cases.rows(alignment.digests(cases.documents(spark, docs)), *COLUMNS) == want


def test_sample(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    assert cases.rows(alignment.digests(docs), *COLUMNS) == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_null_and_repeated_ids(spark):
    docs = [(None, "one two"), (None, "one two"), (5, "three"), (5, "four five"), (5, "three"), (None, None), (7, "")]
    assert cases.rows(alignment.digests(cases.documents(spark, docs)), *COLUMNS) == expected(docs)


def test_groups_and_units():
    import numpy as np
    import pyarrow as pa

    both = alignment.coders(None, None)
    assert both.cuts
    data = np.frombuffer(b" one two  three four", np.uint8)
    assert alignment.unit_starts(data, np.array([0, len(data)]), True).tolist() == [0, 4, 15]
    got = alignment.align_units(pa.array([" one", " x▁", "  "]), both)
    assert got.same.tolist() == [True, False, True] and got.groups.to_pylist()[1:] == ["", "220,220|259"]


def test_empty(spark):
    assert alignment.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
