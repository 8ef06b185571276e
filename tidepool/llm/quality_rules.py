"""Quality rules: distribution divergence from language references.

Each document has two histograms: of character classes, and of its language's
common words. A language's reference is the mean histogram of all its documents
that are long enough and pass the base rules; every language value that occurs has
one of its own. A document is rejected if it fails a base rule, or if it is
long enough for a histogram to mean something and its Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1) from its reference is above the
limits. The references are sums of integers, so any order of rows gives the same.

Cases: a null or empty text has no words and fails the base rule; a language without
a word list is judged by character class only, and not by divergence at all if it is
null or has fewer than ``MIN_REFERENCE`` documents in its reference; repeated rows are
judged each; other columns are not read; an empty table gives an empty result. Texts of
any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.session_tools import ready, rows_that, stage, text_input
from tidepool.llm.textops import LOWER, SPACED, gram_hash, mix, prefix_sums, range_hash, rows_of, slices, spans, text_bytes, word_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: No judgement by histogram below this many words.
GUARD_WORDS = 100
#: Documents that the reference of a language without a word list must have.
MIN_REFERENCE = 20
#: A document is too far if its distance by character class or by common word is above the limit, or if both
#: distances are above the lower pair.
CLASS_LIMIT = 0.25
WORD_LIMIT = 0.30
BOTH_LIMITS = (0.12, 0.255)
SYMBOLS = b"#*$%&|<>"
#: Common function words by language; fixed values.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais elle",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ya este ha",
}
#: Lower-case, upper-case, digit, white space, sentence punctuation, symbols, other ASCII, beyond ASCII.
N_CLASSES = 8
N_BINS = 1 + max(len(w.split()) for w in COMMON.values())
SCALE = 1_000_000
#: Languages whose sums a task holds at once.
HELD_LANGUAGES = 1000


def _classes() -> np.ndarray:
    t = np.full(256, 6, dtype=np.int64)
    t[97:123], t[65:91], t[48:58], t[128:] = 0, 1, 2, 7
    t[[0x20, *range(9, 14)]] = 3
    t[list(b".,;:!?'\"()-")] = 4
    t[list(SYMBOLS)] = 5
    return t


CLASS_OF = _classes()


def _common_tables() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language the sorted hashes of its common words and their bins."""
    out = {}
    for lang, words in COMMON.items():
        data, offsets = text_bytes(pa.array(words.split()))
        h = word_hashes(data, offsets[:-1], offsets[1:])
        order = np.argsort(h)
        out[lang] = h[order], order + 1
    return out


def measure(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The base counts and the two histograms of each row (columns lang, text)."""
    rows = batch.num_rows
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    starts, ends, first = spans(data, offsets, SPACED)
    n_words, row = np.diff(first), rows_of(first, len(starts))

    def per_row(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
        return c[offsets[1:]] - c[offsets[:-1]]

    point = (data & 0xC0) != 0x80  # the first byte of a character
    out = {"n_words": n_words, "word_chars": per_row(point & SPACED[data])}
    kinds = CLASS_OF[data]
    out["n_symbols"] = per_row(kinds == 5)

    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([offsets[1:], breaks]))
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    key = range_hash(prefix_sums(data.astype(np.uint64) + np.uint64(1)), line_start, line_end) + mix(line_row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)

    words = word_hashes(data, starts, ends)
    grams = gram_hash(words, 3)
    place = np.flatnonzero(row[:len(grams)] == row[2:]) if len(grams) else np.empty(0, np.int64)
    key = grams[place] + mix(row[place].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    found = place[order[np.concatenate([same, same + 1])]]
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[found + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)

    byte_row = np.repeat(np.arange(rows), np.diff(offsets))
    out["classes"] = np.bincount(byte_row[point] * N_CLASSES + kinds[point], minlength=rows * N_CLASSES).reshape(rows, N_CLASSES)
    lang = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), dtype=object)
    low = word_hashes(LOWER[data], starts, ends)
    bins = np.zeros(len(low), dtype=np.int64)
    for name, (hashes, number) in _common_tables().items():
        mine = np.flatnonzero((lang == name)[row]) if len(row) else np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(hashes, low[mine]), len(hashes) - 1)
        bins[mine] = np.where(hashes[at] == low[mine], number[at], 0)
    out["words"] = np.bincount(row * N_BINS + bins, minlength=rows * N_BINS).reshape(rows, N_BINS)
    out["lang"] = lang
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    return out


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distance of each row of p from q (or from the same row of q)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def groups(lang: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Each language that is not null and the rows that have it."""
    rows: dict[str, list[int]] = {}
    for i, name in enumerate(lang):
        if name is not None:
            rows.setdefault(name, []).append(i)
    yield from ((name, np.array(at)) for name, at in rows.items())


def references(docs: DataFrame) -> DataFrame:
    """ref_lang, ref (documents, then summed histograms) of each language value, over all documents."""
    ready(docs.sparkSession)
    bins = [f"b{i}" for i in range(1 + N_CLASSES + N_BINS)]

    def rows(total: dict[str, np.ndarray]) -> pa.RecordBatch:
        sums = np.array(list(total.values()), dtype=np.int64).reshape(-1, len(bins))
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *map(pa.array, sums.T)], names=["ref_lang", *bins])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            m = measure(batch)
            fit = ~m["base_failed"] & (m["n_words"] >= GUARD_WORDS)
            each = np.rint(np.hstack([shares(m["classes"]), shares(m["words"])]) * SCALE).astype(np.int64)
            each = np.hstack([np.ones((len(each), 1), np.int64), each])
            for name, at in groups(m["lang"]):
                at = at[fit[at]]
                if len(at):
                    total[name] = total.get(name, 0) + each[at].sum(axis=0)
            if len(total) >= HELD_LANGUAGES:
                yield rows(total)
                total = {}
        yield rows(total)

    got = text_input(docs, "lang", "text").mapInArrow(run, ", ".join(["ref_lang string", *(f"{b} long" for b in bins)]))
    got = got.groupBy("ref_lang").agg(F.array(*(F.sum(b) for b in bins)).alias("ref"))
    return stage(got, "quality-references")  # a table of its own, so that the join can broadcast it or split a hot language


class Judge:
    """Verdicts on batches with the columns text, lang and ref."""

    def __init__(self, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, both_limits: tuple[float, float] = BOTH_LIMITS):
        self.class_limit, self.word_limit, self.both_limits = class_limit, word_limit, both_limits

    def of(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """What was measured, both distances, and judged and kept of each row."""
        m = measure(batch)
        refs = batch.column(batch.schema.get_field_index("ref"))
        by_class, by_word, judged = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=bool)
        for name, at in groups(m["lang"]):
            ref = refs[int(at[0])].as_py()  # the same in all rows of a language
            if ref is None or (name not in COMMON and ref[0] < MIN_REFERENCE):
                continue
            ref = np.array([ref[1:]], dtype=np.float64)
            judged[at] = m["n_words"][at] >= GUARD_WORDS
            by_class[at] = jensen_shannon(shares(m["classes"][at]), shares(ref[:, :N_CLASSES]))
            if name in COMMON:
                by_word[at] = jensen_shannon(shares(m["words"][at]), shares(ref[:, N_CLASSES:]))
        far = judged & ((by_class > self.class_limit) | (by_word > self.word_limit)
                        | (by_class > self.both_limits[0]) & (by_word > self.both_limits[1]))
        return m | {"class_distance": by_class, "word_distance": by_word, "judged": judged, "kept": ~m["base_failed"] & ~far}


def with_references(docs: DataFrame, reference: DataFrame | None) -> DataFrame:
    """Documents and the reference of their language (null without one)."""
    reference = references(docs) if reference is None else reference
    return docs.join(reference, docs["lang"] == reference["ref_lang"], "left").drop("ref_lang")


def judge(docs: DataFrame, reference: DataFrame | None = None, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT,
          both_limits: tuple[float, float] = BOTH_LIMITS) -> DataFrame:
    """One row per document: the base counts, both distances (null where not judged), base_failed and kept."""
    ready(docs.sparkSession)
    rules = Judge(class_limit, word_limit, both_limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            m = rules.of(batch)
            counts = [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(m["base_failed"]), pa.array(m["kept"]),
                 *(pa.array(m[k], mask=~m["judged"]) for k in ("class_distance", "word_distance"))], names=names)

    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean, class_distance double, word_distance double")
    names = [f.split()[0] for f in schema.split(", ")]
    return with_references(text_input(docs, "doc_id", "lang", "text"), reference).mapInArrow(run, schema)


def good(docs: DataFrame) -> DataFrame:
    """The rows of the documents that are kept, with all their columns."""
    rules = Judge()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for batch in slices(batches, "text"):
            yield batch, pa.array(rules.of(batch)["kept"])

    return rows_that(docs, keep, lambda plain: with_references(plain, references(plain)), reads=("text", "lang"))
