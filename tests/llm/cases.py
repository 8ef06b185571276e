"""Small tables with awkward rows."""

from __future__ import annotations

import os

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)

PASSAGE = " ".join(f"w{i}x{i * 7 % 13}" for i in range(60))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One two THREE"), (7, "one two three"),
    (8, PASSAGE), (9, PASSAGE), (10, "head " + PASSAGE + " tail"), (11, PASSAGE.upper()),
    (12, "same " * 90), (13, "same " * 90), (14, "a line\nb\na line\n\n\na line\r\n" * 3),
    (15, "ünï çödé     日本語 テキスト 🎉 x\u0000y " * 20), (16, "MIT License. The Apache-License; gnu General Public License mit license"),
    (17, "<|endoftext|> x<|endoftext|>"), (18, "x" * 5000), (19, PASSAGE + "\n" + PASSAGE),
    (20, " ".join(PASSAGE.split()[5:45])), (21, "﻿\x1c\x1d a\x85b\x0b\x0c"), (22, (PASSAGE + " ") * 40),
]


def documents(spark, rows=ODD, extra=True):
    """doc_id, text, lang, source, n_chars; with columns whose names clash with the operators' own."""
    langs = ["en", None, "fr", "xx"]
    data = [(d, t, langs[i % 4], f"s{i % 3}" if i % 5 else None, len(t or "")) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in ("n_words", "anchor", "matches", "component_id", "kept", "words", "label", "host", "a.b"):
            df = df.selectExpr("*", f"'clash' as `{c}`")
    return df


def sample(spark):
    """The smallest table and the odd rows under ids of their own."""
    from functools import reduce

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = documents(spark, [(10_000_000 + d, t) for d, t in ODD], extra=False)
    return reduce(lambda a, b: a.unionByName(b), [docs, odd])


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(data):
    return sorted(data, key=lambda r: tuple((x is not None, x) for x in r))
