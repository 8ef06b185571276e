"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Texts are cut into units, at single spaces between printable ASCII characters. Both
tokenizers end a token there: one never takes a space into a token after another
character, and the other has no piece that holds a space after another character. So a
unit's tokens, groups and links are the same in every text, and distinct units of a slice
are tokenized once.

All else is Arrow: ids of the distinct units are list arrays; flattened, with their parent
indices and a cumulative sum of token lengths that starts anew in each unit, they give
the byte at which each token ends; an Acero hash join on (unit, end) gives the links, whose
ends cut both token lists into groups; lists of units by document are joined back by
``take``. ``Table.group_by`` counts the id pairs of a slice of documents; Spark adds these
counts up and joins them to each document's pairs (as a broadcast where the counts are
small, else by a shuffle that splits hot pairs).

Cases: a text that is null, empty or not given back byte for byte by both tokenizers (a
U+2581 in it, say) has no tokens and zeros; special tokens' strings are plain text; rows
that repeat a doc_id or have none are aligned each; texts of any length are read whole, in
units, and only a unit is bound by memory; ties for a B id's highest count all count as best;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bpe import byte_symbols
from tidepool.llm.session_tools import ready, stage, text_input
from tidepool.llm.textops import slices, text_bytes

SLICE_TEXT = 4 << 20
#: Units that a tokenizer sees at once: its own results are larger than the ids.
ENCODED_UNITS = 8192
#: An id pair is one number: A's id above, B's below.
B_BITS = 24
PRINTABLE = np.zeros(256, dtype=bool)
PRINTABLE[0x21:0x7F] = True
#: Fixed value: what stands for a space in pieces.
PIECE_SPACE = "▁"


class Coders:
    """Both tokenizers and the bytes of each of their tokens."""

    def __init__(self, a_file: str | None, b_file: str | None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file or public("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        back = {c: b for b, c in enumerate(byte_symbols())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        words = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            words[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        self.a_bytes = pa.array(words, pa.binary())
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file or public("piece_bpe_32k.model"))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(PIECE_SPACE, " ").encode()
                                 for i, p in enumerate(pieces)], pa.binary())
        #: Whether texts may be cut before a space: no piece may reach over such a place.
        self.cuts = not any(PIECE_SPACE in p.lstrip(PIECE_SPACE) for p in pieces)

    def lists(self, units: pa.StringArray) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of each unit; a unit starts with a space, which B adds itself."""
        kind = pa.list_(pa.int32())
        parts = [(pa.array([], kind), pa.array([], kind))]
        for i in range(0, len(units), ENCODED_UNITS):
            texts = units.slice(i, ENCODED_UNITS).to_pylist()
            a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            b = self.b.encode([t[1:] for t in texts], num_threads=1)
            parts.append((pa.array(a, kind), pa.array(b, kind)))
        return tuple(pa.concat_arrays(x) for x in zip(*parts, strict=True))


def public(name: str) -> str:
    """The file of a public tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def coders(a_file: str | None, b_file: str | None) -> Coders:
    return Coders(a_file, b_file)


@dataclass
class Tokens:
    """The flattened tokens of all units: id, unit, and the byte of the unit at which each ends."""

    ids: pa.Array
    unit: pa.Array
    end: pa.Array
    per_unit: np.ndarray
    same: np.ndarray  # units whose joined token bytes are their own bytes

    @classmethod
    def of(cls, lists: pa.ListArray, token_bytes: pa.BinaryArray, units: pa.StringArray) -> Tokens:
        ids, unit = lists.flatten(), pc.list_parent_indices(lists)
        joined = pc.take(token_bytes, ids)
        total = pc.cumulative_sum(pc.binary_length(joined).cast(pa.int64()))
        offsets = np.asarray(lists.offsets)
        before = np.concatenate([[0], np.asarray(total)])[offsets]  # sums start anew in each unit
        end = pc.subtract(total, pc.take(pa.array(before), unit))
        # The bytes of all tokens, cut where units end.
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(before.astype(np.int64)), pa.py_buffer(contents(joined))])
        same = np.asarray(pc.equal(whole, units.cast(pa.large_binary())))
        return cls(ids, unit, end, np.diff(offsets), same)

    def only(self, good: np.ndarray) -> Tokens:
        """Without the tokens of other units."""
        keep = pa.array(good[np.asarray(self.unit)])
        return Tokens(self.ids.filter(keep), self.unit.filter(keep), self.end.filter(keep), self.per_unit * good, self.same)

    def table(self, name: str) -> pa.Table:
        return pa.table({"unit": self.unit, "end": self.end, name: self.ids, f"{name}_at": np.arange(len(self.ids))})

    def keys(self) -> np.ndarray:
        return (np.asarray(self.unit).astype(np.int64) << 40) + np.asarray(self.end)


def contents(column: pa.BinaryArray) -> bytes:
    """All values of a column in one buffer."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return b"" if column.buffers()[2] is None else memoryview(column.buffers()[2])[offsets[0]:offsets[-1]]


@dataclass
class Aligned:
    """What is known of each unit: token numbers, links as id pairs, and its groups as text."""

    same: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: pa.ListArray
    groups: pa.StringArray


def align_units(units: pa.StringArray, both: Coders) -> Aligned:
    lists = both.lists(units)
    a, b = Tokens.of(lists[0], both.a_bytes, units), Tokens.of(lists[1], both.b_bytes, units)
    same = a.same & b.same
    if not same.all():
        a, b = a.only(same), b.only(same)
    linked = a.table("a").join(b.table("b"), ["unit", "end"], join_type="inner", use_threads=False)
    linked = linked.sort_by([("a_at", "ascending"), ("b_at", "ascending")])
    unit, end = (np.asarray(linked[c]).astype(np.int64) for c in ("unit", "end"))
    cut = (unit << 40) + end
    new = np.ones(len(cut), dtype=bool)
    new[1:] = cut[1:] != cut[:-1]
    pair = (np.asarray(linked["a"]).astype(np.int64) << B_BITS) | np.asarray(linked["b"])
    n_links = np.bincount(unit, minlength=len(units))
    n_groups = np.bincount(unit[new], minlength=len(units))
    sides = []
    for x in (a, b):
        # A group ends with the last token that ends at its cut.
        ends = np.searchsorted(x.keys(), cut[new], side="right")
        sides.append(pc.binary_join(as_lists(ends, x.ids.cast(pa.string())), ","))
    groups = pc.binary_join(as_lists(np.cumsum(n_groups), pc.binary_join_element_wise(*sides, "|")), ";")
    return Aligned(same, a.per_unit, b.per_unit, n_groups, as_lists(np.cumsum(n_links), pa.array(pair)), groups)


def as_lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Consecutive values as lists with these ends."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def unit_starts(data: np.ndarray, offsets: np.ndarray, cut: bool) -> np.ndarray:
    """Where units start in the joined texts, each of which starts with a space of its own."""
    starts = np.zeros(len(data), dtype=bool)
    if cut:
        starts[1:-1] = (data[1:-1] == 0x20) & PRINTABLE[data[:-2]] & PRINTABLE[data[2:]]
    starts[offsets[:-1]] = True
    return np.flatnonzero(starts)


@dataclass
class Documents:
    """Distinct units of a slice, and each document's units in order."""

    units: Aligned
    index: np.ndarray
    first: np.ndarray  # each document's first place in index, one more at the end

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[self.index])])
        return total[self.first[1:]] - total[self.first[:-1]]


def align_texts(texts: pa.StringArray, both: Coders, cut: bool) -> tuple[Documents, np.ndarray]:
    """The alignment of texts that are not empty, and which of them both tokenizers give back."""
    spaced = pc.binary_join_element_wise(pa.scalar(""), texts, " ")
    data, offsets = text_bytes(spaced)
    starts = unit_starts(data, offsets, cut)
    joined = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data))
    coded = joined.dictionary_encode()
    docs = Documents(align_units(coded.dictionary, both), np.asarray(coded.indices), np.searchsorted(starts, offsets))
    return docs, docs.sums(~docs.units.same) == 0


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, with_groups: bool = True) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups (or groups_sha256), pairs and times (distinct id pairs and their links).

    ``row`` numbers the rows until they are written. The files, if given, must be on every machine.
    """
    ready(docs.sparkSession)
    text = "groups" if with_groups else "groups_sha256"
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, {text} string, pairs array<long>, times array<int>"

    def rows(docs: Documents, keep: np.ndarray) -> dict[int, tuple]:
        """The results of the kept documents, by place."""
        if not keep.any():
            return {}
        unit, places = docs.units, np.flatnonzero(keep)
        owner = np.repeat(np.arange(len(keep)), np.diff(docs.first))
        chosen = keep[owner]
        owner, index = pa.array(owner[chosen]), pa.array(docs.index[chosen])
        links = pc.take(unit.links, index)
        table = pa.table({"doc": pc.take(owner, pc.list_parent_indices(links)), "pair": links.flatten()})
        table = table.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")])
        ends = np.searchsorted(np.asarray(table["doc"]), places, side="right")
        pairs = as_lists(ends, table["pair"].combine_chunks()).to_pylist()
        times = as_lists(ends, table["count_all"].combine_chunks().cast(pa.int32())).to_pylist()
        counts = np.diff(docs.first)[places]
        groups = pc.binary_join(as_lists(np.cumsum(counts), pc.take(unit.groups, index)), ";")
        if not with_groups:
            groups = [hashlib.sha256(g.as_buffer()).hexdigest() for g in groups]
        else:
            groups = groups.to_pylist()
        n_links = np.diff(np.asarray(unit.links.offsets))
        numbers = [docs.sums(x)[places].tolist() for x in (unit.n_a, unit.n_b, unit.n_groups, n_links)]
        return dict(zip(places.tolist(), zip(*numbers, groups, pairs, times, strict=True), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coders(a_file, b_file)
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", SLICE_TEXT):
            column = batch.column(1)
            there = np.flatnonzero(np.asarray(pc.fill_null(pc.binary_length(column), 0)) > 0)
            out: list[tuple] = [(0, 0, 0, 0, "", [], [])] * batch.num_rows
            if len(there):
                found, good = align_texts(column.take(pa.array(there)), both, both.cuts)
                for at, result in rows(found, good).items():
                    out[there[at]] = result
                # A document with a unit that is not given back counts as a whole.
                for at in there[~good].tolist():
                    whole, good_too = align_texts(column.slice(at, 1), both, False)
                    out[at] = rows(whole, good_too).get(0, out[at])
            columns = [np.arange(number, number + batch.num_rows), batch.column(0), *zip(*out, strict=True)]
            number += batch.num_rows
            kinds = [*[pa.int64()] * 6, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", text, "pairs", "times"])

    return text_input(docs, "doc_id", "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of all documents hold each id pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({"pair": batch.column(0).flatten(), "n": batch.column(1).flatten()})
            yield from table.group_by("pair", use_threads=False).aggregate([("n", "sum")]).select(["pair", "n_sum"]).rename_columns(["pair", "n"]).to_batches()

    return aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def digests(docs: DataFrame, **files) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    aligned = stage(align(docs, with_groups=False, **files), "aligned")
    counts = stage(pair_counts(aligned), "pair-counts")
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b")
    counts = counts.select("pair", "n", b_id)
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary
    counts = stage(counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-counts")
    links = aligned.select("row", F.inline(F.arrays_zip("pairs", "times"))).toDF("row", "pair", "times")
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
