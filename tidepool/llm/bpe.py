"""Byte-level BPE: encoding by merge ranks and decoding, with a public vocabulary file.

Each pre-token is a doubly linked list of symbols. A priority queue holds the
adjacent pairs that have a merge, ordered by merge rank and place; an entry whose
symbols have changed since it was queued is stale and skipped. Decoding
concatenates the vocabulary's byte strings and reads them as UTF-8 (malformed
bytes become U+FFFD). Pre-tokens recur, so each task keeps a bounded memo of them.

Cases: a null or empty text has no tokens and decodes to the empty text; the
special token's string in a text is that one token; repeated rows are encoded
each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidepool.llm.session_tools import ready, text_input
from tidepool.llm.textops import slices

#: The pre-tokenizer's pattern of byte-level BPE. Its white space is Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers of Unicode versions after the one that the vocabulary's own library
#: knows; it takes them as symbols.
LATER = (
    "\\u0558\\u058B-\\u058C\\u088F\\u0C5C\\u0CDC\\u208F\\u209D-\\u209F\\uA7CE-\\uA7CF\\uA7D2\\uA7D4\\uA7DD\\uA7E2\\uA7F1"
    "\\uAB6C-\\uAB6D\\U000107BB-\\U000107BF\\U00010940-\\U00010959\\U00010EC5-\\U00010EC7\\U00010ED9-\\U00010EEE"
    "\\U00011B0A\\U00011DB0-\\U00011DDB\\U00011DE0-\\U00011DE9\\U00011DF1\\U0001246F\\U00012475-\\U0001247F"
    "\\U00012550-\\U00012686\\U00016EA0-\\U00016EB8\\U00016EBB-\\U00016ED3\\U00016FF2-\\U00016FF6\\U000187F8-\\U000187FF"
    "\\U00018CD6-\\U00018CDA\\U00018D09-\\U00018D20\\U00018D80-\\U00018DF2\\U00018E00-\\U00019191\\U000191A0-\\U000191D2"
    "\\U0001B123-\\U0001B128\\U0001B168\\U0001D6A6\\U0001DF1F-\\U0001DF24\\U0001DF2B-\\U0001DF81\\U0001DF90-\\U0001DF96"
    "\\U0001DFCD-\\U0001DFFF\\U0001E6C0-\\U0001E6DE\\U0001E6E0-\\U0001E6E2\\U0001E6E4-\\U0001E6E5\\U0001E6E7-\\U0001E6ED"
    "\\U0001E6F0-\\U0001E6F4\\U0001E6FE-\\U0001E6FF\\U0002B73A-\\U0002B73F\\U0002B81E\\U0002CEA2-\\U0002CEAD"
    "\\U000323B0-\\U00033479\\U0003D000-\\U0003FC3F"
)
#: The same pattern for texts below U+0250 without the numbers among superscripts and fractions.
LATIN = PATTERN.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d").replace(r"[^\s\w]", r"[^\w\t-\r \x85\xa0]").replace(r"\s", r"[\t-\r \x85\xa0]").replace(r"\S", r"[^\t-\r \x85\xa0]")
EXACT = (PATTERN.replace(r"\p{L}+|", rf"[\p{{L}}--[{LATER}]]+|").replace(r"\p{N}+|", rf"[\p{{N}}--[{LATER}]]+|")
         .replace(r"[^\s\p{L}\p{N}]+", rf"[[^\s\p{{L}}\p{{N}}]||[{LATER}]]+"))
#: Entries of the memo, about 200 bytes each.
MEMO = 500_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Bpe(dict):
    """One vocabulary: ``encode`` gives ids, ``decode`` the text. As a dict it is the memo of pre-tokens."""

    def __init__(self, spec: dict):
        model, symbols = spec["model"], byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        vocab = model["vocab"]
        self.first = [vocab[symbols[b]] for b in range(256)]
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.byte_ranks = {(a, b): r for a in range(256) for b in range(256)
                           if (r := self.ranks.get(self.first[a] << 20 | self.first[b])) is not None}
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for word, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in word)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find_latin = re.compile(LATIN).findall
        self.find, self.find_exactly = regex.compile(PATTERN).findall, regex.compile(EXACT, regex.V1).findall
        self.later = regex.compile(f"[{LATER}]").search
        self.shown = [str(i) for i in range(len(self.bytes))]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: merges in the order of rank, then place."""
        ids = [*map(self.first.__getitem__, data)]
        n = len(ids)
        if n < 2:
            return ids
        ranks = [*map(self.byte_ranks.get, zip(data, data[1:], strict=False))]
        bits = n.bit_length()
        place = (1 << bits) - 1
        queue = [r << bits | i for i, r in enumerate(ranks) if r is not None]
        if not queue:
            return ids
        heapify(queue)
        rank_of, made = self.ranks.get, self.made
        left, right = [*range(-1, n - 1)], [*range(1, n), -1]
        ranks.append(None)  # ranks[i]: of the pair that now starts at i
        while queue:
            r = heappop(queue)
            i = r & place
            r >>= bits
            if ranks[i] != r:
                continue  # stale: one of the pair's symbols has been merged meanwhile
            j = right[i]
            ids[i] = new = made[r]
            ids[j] = -1
            ranks[j] = None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                ranks[i] = r = rank_of(new << 20 | ids[k])
                if r is not None:
                    heappush(queue, r << bits | i)
            else:
                ranks[i] = None
            h = left[i]
            if h >= 0:
                ranks[h] = r = rank_of(ids[h] << 20 | new)
                if r is not None:
                    heappush(queue, r << bits | h)
        return [x for x in ids if x >= 0]

    def __missing__(self, word: str) -> tuple[str, bytes]:
        """The ids of a pre-token not in the memo, as text, and their decoded bytes."""
        ids = self.merge(word.encode())
        entry = ",".join([self.shown[i] for i in ids]), b"".join([self.bytes[i] for i in ids])
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = entry
        return entry

    def ordinary(self, text: str) -> list[tuple[str, bytes]]:
        last = max(text, default="")
        if last < "\u0250" and not any(c in text for c in "\xb2\xb3\xb9\xbc\xbd\xbe"):
            find = self.find_latin
        elif last < "\u0558" or not self.later(text):
            find = self.find
        else:
            find = self.find_exactly
        return [self[word] for word in find(text)]

    def entries(self, text: str) -> list[tuple[str, bytes]]:
        """(ids as text, bytes) of each pre-token and special token of a text."""
        out: list[tuple[str, bytes]] = []
        at = 0
        for m in self.split_special.finditer(text) if any(s in text for s in self.special) else ():
            out += self.ordinary(text[at:m.start()])
            out.append((self.shown[self.special[m[0]]], self.bytes[self.special[m[0]]]))
            at = m.end()
        return out + self.ordinary(text[at:] if at else text)

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self.entries(text) for i in x[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, once per Python worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            _LOADED[path] = Bpe(json.load(f))
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, decoded of every document. ``vocabulary``: a file that every machine has."""
    def row(bpe: Bpe, text: str) -> tuple:
        ids = bpe.encode(text)
        return ids, bpe.decode(ids)

    return _apply(docs, vocabulary, "doc_id long, ids array<int>, decoded string", row)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    def row(bpe: Bpe, text: str) -> tuple:
        entries = bpe.entries(text)
        ids = ",".join([x[0] for x in entries])
        decoded = b"".join([x[1] for x in entries]).decode("utf-8", "replace")
        return ids.count(",") + bool(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded))

    return _apply(docs, vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def _apply(docs: DataFrame, vocabulary: str | None, schema: str, row) -> DataFrame:
    ready(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        try:
            for batch in slices(batches, "text"):
                rows = [row(bpe, t or "") for t in batch.column(1).to_pylist()]
                arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[f for f, _ in fields])
        finally:
            bpe.clear()  # the worker lives on, with other stages' tasks

    return text_input(docs, "doc_id", "text").mapInArrow(run, schema)
