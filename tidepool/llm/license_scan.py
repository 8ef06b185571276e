"""License scans by a positional index of rare words. DataFrame functions only.

A template is a word sequence of a licence notice. Its words are weighted by their
inverse frequency among the templates; the two rarest words and their places are
its index entries. A file's words are looked up in the index; each word found at
place i votes for the starts i - p, and a template can begin only where the votes
of its rare words meet. There its mandatory key phrase must stand word for word, and
the weight share of the template's words in their places must reach ``MIN_SHARE``.
The three base phrases are templates that are all key phrase.

Nothing is shuffled: a file is matched in its own row, in time linear in its words.

Cases: a null or empty text has no words and no labels; repeated rows are scanned
each; other columns are not read; an empty table gives an empty result; texts of any
length are scanned whole.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.session_tools import text_input

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: digits, ASCII letters and all beyond ASCII. After lower-casing A-Z the same places hold the words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MIN_SHARE = 0.8
#: Label by base phrase; fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label: (notice, mandatory key phrase in it). Wording of well-known licence notices.
NOTICES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "agpl": ("gnu affero general public license", "affero general public license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    "cc-by": ("licensed under cc by 4 0", "cc by 4 0"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa 4 0"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    "lgpl": ("gnu lesser general public license", "lesser general public license"),
    "mit-notice": ("released under the mit license", "under the mit license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free"),
    "mpl": ("mozilla public license version 2 0", "mozilla public license"),
    "unlicense": ("free and unencumbered software released into the public domain", "unencumbered software"),
}


class Template:
    """Words, weights, index entries (the rarest words) and the key phrase's place."""

    def __init__(self, label: str, text: str, key: str, documents: Counter, n: int):
        self.label, self.words = label, text.split()
        key_words = key.split()
        self.key_at = next(i for i in range(len(self.words)) if self.words[i:i + len(key_words)] == key_words)
        self.key = key_words
        self.weights = [round(math.log(1 + n / documents[w]), 6) for w in self.words]
        rare = sorted(range(self.key_at, self.key_at + len(key_words)), key=lambda i: (-self.weights[i], i))
        self.entries = [(self.words[i], i) for i in rare[:2]]
        self.is_base = text == key and text in BASE


def templates() -> list[Template]:
    texts = [(label, p, p) for p, label in BASE.items()] + [(label, *t) for label, t in NOTICES.items()]
    documents = Counter(w for _, t, _ in texts for w in set(t.split()))
    return [Template(label, t, key, documents, len(texts)) for label, t, key in texts]


def starts(t: Template, places: dict[str, Column], words: Column) -> Column:
    """Where the votes of the rare words meet and the key phrase stands."""
    def start_of(p: int):
        return lambda i: i - F.lit(p)

    votes = [F.transform(places[w], start_of(p)) for w, p in t.entries]
    met = reduce(F.array_intersect, votes)
    return F.filter(met, lambda s: reduce(lambda a, b: a & b, [
        F.coalesce(F.get(words, s + F.lit(t.key_at + k)) == F.lit(w), F.lit(False)) for k, w in enumerate(t.key)]))


def best_share(t: Template, found: Column, words: Column) -> Column:
    """The largest share among the starts found, 0 without any."""
    return F.coalesce(F.array_max(F.transform(found, lambda start: share(t, start, words))), F.lit(0.0))


def word_is(word: str):
    return lambda hit: hit["x"] == F.lit(word)


def share(t: Template, start: Column, words: Column) -> Column:
    """The weight share of the template's words that stand in their places."""
    hit = [F.when(F.get(words, start + F.lit(i)) == F.lit(w), F.lit(x)).otherwise(F.lit(0.0)) for i, (w, x) in enumerate(zip(t.words, t.weights, strict=True))]
    return reduce(lambda a, b: a + b, hit) / F.lit(reduce(lambda a, b: a + b, t.weights))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best weight share of a notice found in the file, at least 0.5 where only a base phrase is.
    """
    index = templates()
    rare = sorted({w for t in index for w, _ in t.entries})
    text = F.coalesce(F.col("text"), F.lit(""))
    # Each template has an index word that is a plain substring of the lower-cased text, so this loses no file.
    needed = sorted({min((w for w, _ in t.entries), key=lambda w: (-len(w), w)) for t in index})
    low = F.lower(text)
    likely = reduce(lambda a, b: a | b, [low.contains(w) for w in needed])
    df = text_input(docs, "doc_id", "text").select("doc_id", text.alias("t"), likely.alias("likely"))
    df = df.select("doc_id", F.when(~F.col("likely"), F.regexp_count("t", F.lit(WORD))).alias("n"), F.when(
        F.col("likely"), F.regexp_extract_all(F.translate("t", UPPER, LOWER), F.lit(WORD), F.lit(0)))
        .otherwise(F.array().cast("array<string>")).alias("w"))
    df = df.select("doc_id", F.coalesce("n", F.size("w")).cast("long").alias("n_words"), "w", F.filter(
        F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isin(rare)).alias("hits"))
    df = df.select("doc_id", "n_words", "w", *[
        F.transform(F.filter("hits", word_is(w)), lambda h: h["i"]).alias(f"p{k}") for k, w in enumerate(rare)])
    places = {w: F.col(f"p{k}") for k, w in enumerate(rare)}
    words = F.col("w")
    df = df.select("doc_id", "n_words", "w", *[starts(t, places, words).alias(f"s{k}") for k, t in enumerate(index)])
    base = [k for k, t in enumerate(index) if t.is_base]
    best = {k: best_share(t, F.col(f"s{k}"), words) for k, t in enumerate(index) if not t.is_base}
    df = df.select("doc_id", "n_words", *[f"s{k}" for k in base], *[c.alias(f"b{k}") for k, c in best.items()])
    first = F.least(*[F.array_min(f"s{k}") for k in base])
    last = F.greatest(*[F.array_max(f"s{k}") for k in base])
    n_base = reduce(lambda a, b: a + b, [F.size(f"s{k}") for k in base])

    def joined(parts: list[Column]) -> Column:
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))))

    base_labels = [F.when(F.size(f"s{k}") > 0, F.lit(index[k].label)) for k in base]
    more = [F.when(F.col(f"b{k}") >= F.lit(MIN_SHARE), F.lit(index[k].label)) for k in best]
    score = F.greatest(F.when(n_base > 0, F.lit(0.5)).otherwise(F.lit(0.0)), *[
        F.when(F.col(f"b{k}") >= F.lit(MIN_SHARE), F.col(f"b{k}")).otherwise(F.lit(0.0)) for k in best])
    return df.select("doc_id", "n_words", n_base.cast("long").alias("n_base"), first.cast("long").alias("first_word"),
                     last.cast("long").alias("last_word"), joined(base_labels).alias("base_labels"),
                     joined([*base_labels, *more]).alias("labels"), F.round(score, 6).alias("score"))


def oracle(table: str = "documents") -> str:
    """The same result in DuckDB: every template is tried at every word."""
    index = templates()
    upper = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def at(t: Template) -> str:
        key = " AND ".join(f"coalesce(w[i + {t.key_at + k + 1}] = '{x}', false)" for k, x in enumerate(t.key))
        return f"list_filter(range(len(w)), lambda i: {key})"

    def weight(t: Template) -> str:
        hit = " + ".join(f"(CASE WHEN w[i + {k + 1}] = '{x}' THEN {y}::DOUBLE ELSE 0.0::DOUBLE END)" for k, (x, y) in enumerate(zip(t.words, t.weights, strict=True)))
        return f"({hit}) / ({' + '.join(f'{y}::DOUBLE' for y in t.weights)})"

    def labels(parts: list[str]) -> str:
        return f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))), ',')"

    base = [k for k, t in enumerate(index) if t.is_base]
    more = [k for k, t in enumerate(index) if not t.is_base]
    base_labels = [f"CASE WHEN len(s{k}) > 0 THEN '{index[k].label}' END" for k in base]
    more_labels = [f"CASE WHEN b{k} >= {MIN_SHARE} THEN '{index[k].label}' END" for k in more]
    n_base = " + ".join(f"len(s{k})" for k in base)
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{upper}') AS w FROM {table}),
places AS (SELECT doc_id, w, {', '.join(f'{at(t)} AS s{k}' for k, t in enumerate(index))} FROM words),
shares AS (SELECT doc_id, len(w) AS n_words, {', '.join(f's{k}' for k in base)},
  {', '.join(f'coalesce(list_max(list_transform(s{k}, lambda i: {weight(index[k])})), 0.0) AS b{k}' for k in more)} FROM places)
SELECT doc_id, n_words, {n_base} AS n_base, least({', '.join(f'list_min(s{k})' for k in base)}) AS first_word,
  greatest({', '.join(f'list_max(s{k})' for k in base)}) AS last_word, {labels(base_labels)} AS base_labels,
  {labels(base_labels + more_labels)} AS labels,
  round(greatest(CASE WHEN {n_base} > 0 THEN 0.5 ELSE 0.0 END, {', '.join(f'CASE WHEN b{k} >= {MIN_SHARE} THEN b{k} ELSE 0.0 END' for k in more)}), 6) AS score
FROM shares"""
