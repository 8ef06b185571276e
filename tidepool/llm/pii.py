"""PII: detected entities receive keyed surrogates of the same type, format, script and gender.

A surrogate is made by a keyed permutation without fixed points over all strings of the
entity's form: digits stay digits, letters stay letters of their case and script, and
separators stay. Equal entities so get equal surrogates in every document (coreference),
different entities different ones (distinctness), with no table to share; ``collisions``
checks both over a whole corpus and tells which surrogates equal a real entity, and ``report``
runs it. Whoever has the key can undo the surrogates, so there is no default one: it is an
argument, and the registered queries take the session's (``spark.tidepool.surrogateKey``, else a
random one that only lives as long as the session). By type:

- e-mail (international domains too): the local part and the domain labels are permuted, below the
  reserved domain ``example``; identity ignores case, the written case is put back;
- phone, social security and card numbers: digits only, so any way of writing a number leads to
  the same digits; a phone keeps its country code or leading zero, a card number its checksum's validity;
- IP address, of either version: another address, the same however the address is written;
- IBAN and secrets (values of named fields, bearer tokens, keys, private-key blocks): letters and
  digits in place, hexadecimal stays hexadecimal;
- person after a title or an introduction ("my name is"): the title, which tells the gender, stays; a known
  given name becomes another one of that gender, other names change vowels for vowels and consonants
  for consonants of their script; the same names elsewhere in that document become the same.

Cases: a null text stays null, an empty one empty; an entity that overlaps an earlier
one is part of it; repeated rows are treated alike; other columns pass through in ``replace``;
an empty table gives an empty result. Texts of any length are read whole, in time about
linear in their length. Not found: names without a title or introduction anywhere in the document,
postal addresses, local phone numbers without a leading zero or area code.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.session_tools import ready, stage, text_input
from tidepool.llm.textops import slices

KEY_SETTING = "spark.tidepool.surrogateKey"
ROUNDS = 8
#: Longer entities are moved in pieces of so many characters.
PIECE = 1024
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Letters that replace each other, by script and case.
ALPHABETS = (
    DIGITS, LOWER, UPPER, "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))),
    "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2), "".join(chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2),
)
ALPHABET_OF = {c: a for a in ALPHABETS for c in a}
#: Titles and given names by gender.
TITLES = {
    "m": "Mr Herr Señor Sr Monsieur Signor Господин Κύριος",
    "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Mlle Signora Госпожа Κυρία",
    "x": "Dr Prof Professor Mx",
}
GIVEN = {
    "m": "James John Robert Michael William David Thomas Daniel Paul Mark Peter Hans Karl Jean Pierre Luis Carlos Juan José Miguel",
    "f": "Mary Anna Linda Susan Karen Nancy Lisa Emma Laura Sarah Julia Petra Heike Marie Claire Sophie Carmen Lucía Elena Rosa",
}
GENDER_OF = {n: g for g, names in GIVEN.items() for n in names.split()}
_TITLE = "|".join(sorted({t for v in TITLES.values() for t in v.split()}, key=lambda t: (-len(t), t)))
_NAME = r"[^\W\d_a-z](?:[^\W\d_]|['’](?=[^\W\d_a-z]))++"
_KNOWN = "|".join(sorted(n.lower() for n in GENDER_OF))
_HEXES = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
#: Letters of names: vowels replace vowels, consonants consonants, by script and case.
NAME_ALPHABET_OF = ALPHABET_OF | {c: a for v, a_ in (("aeiouy", LOWER), ("аеёиоуыэюя", ALPHABETS[5]), ("αεηιουω", ALPHABETS[7]))
                                  for vowels, letters in ((v, a_), (v.upper(), a_.upper()))
                                  for a in ("".join(c for c in letters if c in vowels), "".join(c for c in letters if c not in vowels)) for c in a}

#: (kind, pattern, what makes it possible at all). The entity is group 1 where there is one. Earlier kinds win ties.
PATTERNS: tuple[tuple[str, re.Pattern, Callable[[str], bool]], ...] = tuple((k, re.compile(p), f) for k, p, f in (
    ("email", r"(?<![\w.%+-])[\w.%+-]++@[^\W_][\w-]*+(?:\.[\w-]++)++", lambda t: "@" in t),
    ("secret", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s{0,4}([A-Za-z0-9+/=\s]{8,}+)-----END", lambda t: "PRIVATE KEY" in t),
    ("secret", r"(?i:\bbearer\s{1,3})(?=\S*\d)([A-Za-z0-9._~+/=-]{16,}+)", lambda t: "earer" in t or "EARER" in t),
    ("secret", r"""(?i:\b(?:passw(?:or)?d|passwort|passphrase)\s{1,3}(?:is|ist)\s{1,3})["']?(?=[^\s"'<>]*\d)([^\s"'<>]{8,}+)""", lambda t: "is" in t or "IS" in t),
    ("secret", r"""(?i:\b(?:token|secret|api[_-]?key|passw(?:or)?d|passwd)\b)["']?\s{0,3}[=:]\s{0,3}["']?([^\s"'<>]{8,}+)""",
     lambda t: "=" in t or ":" in t),
    ("secret", r"\b((?:AKIA|ASIA)[0-9A-Z]{16,}+\b|gh[pousr]_[0-9A-Za-z]{36,}+\b|sk-[0-9A-Za-z_-]{20,}+)", lambda t: "AKIA" in t or "ASIA" in t or "gh" in t or "sk-" in t),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)", lambda t: "." in t),
    ("ip6", rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:{_HEXES}{{7}}|(?:{_HEXES}{{0,6}})?::(?:{_HEXES}{{0,6}})?)(?![\w:])", lambda t: ":" in t),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", lambda t: True),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", lambda t: "-" in t),
    ("ssn", r"\b(?:SSN|ssn)(?: is)?:? ?(\d{3}[ -]?\d{2}[ -]?\d{4})(?![\d-])", lambda t: "SSN" in t or "ssn" in t),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)", lambda t: "+" in t),
    ("phone", r"(?<![\w(+])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)", lambda t: True),
    ("phone", r"(?<![\w.+-])0[1-9](?:([ .-])\d{2})(?:\1\d{2}){3}(?!\w|[.-]\d)", lambda t: "0" in t),
    ("phone", r"(?<![\w.+/-])0[1-9]\d{1,3}[-/ ]\d{5,8}(?!\w|[.-]\d)", lambda t: "0" in t),
    ("phone", r"(?<!\w)\(0[1-9]\d{0,3}\) ?\d{4,9}(?!\w)", lambda t: "(0" in t),
    ("card", r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d|[ -]\d)", lambda t: True),
    ("person", rf"\b(?:{_TITLE})\.?[ \u00a0]{_NAME}(?:[ \u00a0-]{_NAME}){{0,2}}", lambda t: bool(_HAS_TITLE(t))),
    ("person", rf"\b(?:mr|mrs|ms|miss|dr|prof)\.? (?:{_KNOWN}) [a-z]{{2,}}+", lambda t: "m" in t or "dr" in t or "prof" in t),
    ("name", rf"\b(?:[Mm]y name is|[Ii]ch hei(?:ß|ss)e|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo)[ \u00a0]({_NAME}(?:[ \u00a0-]{_NAME}){{0,2}})", lambda t: "me" in t or "eiss" in t or "eiß" in t or "appelle" in t),
))
_HAS_DIGITS = re.compile(r"\d").search
_HAS_TITLE = re.compile(rf"\b(?:{_TITLE})\.?[ \u00a0]").search
_WORDS = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_TITLES = {t for v in TITLES.values() for t in v.split()}
NEEDS_DIGITS = {"ip", "ip6", "iban", "ssn", "phone", "card"}
#: Patterns whose entity is their first group (in others a group is only referred to).
_INNER = {"secret", "ssn", "name"}


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, without overlaps."""
    found = []
    digits = bool(_HAS_DIGITS(text))
    for priority, (kind, pattern, possible) in enumerate(PATTERNS):
        if (kind in NEEDS_DIGITS and not digits) or not possible(text):
            continue
        for m in pattern.finditer(text):
            start, end = m.span(1) if kind in _INNER and pattern.groups else m.span()
            if kind == "ip6" and not _is_ip6(m[0]):
                continue
            found.append((start, priority, end, kind))
    named = set()
    for start, _, end, kind in found:
        if kind in ("person", "name"):
            named.update(re.split(r"[ \u00a0-]", text[start:end])[kind == "person":])
    named -= _TITLES
    if named:
        found += ((m.start(), len(PATTERNS), m.end(), "mention") for m in _WORDS.finditer(text) if m[0] in named)
    out, at = [], 0
    for start, _, end, kind in sorted(found):
        if start >= at:
            out.append((start, end, kind))
            at = end
    return out


def _is_ip6(value: str) -> bool:
    try:
        return len(value) > 4 and bool(ipaddress.IPv6Address(value))
    except ValueError:
        return False


_SESSION_KEYS: dict[str, str] = {}


def session_key(spark) -> str:
    """The session's secret key: its setting, else a random one for as long as the application lives."""
    return spark.conf.get(KEY_SETTING, None) or _SESSION_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


class Surrogates:
    """Keyed surrogates. Each ``kind`` and form of a string has a permutation of its own."""

    def __init__(self, key: str):
        if not key:
            raise ValueError("surrogates need a secret key")
        self.key = hashlib.sha256(key.encode()).digest()

    def _round(self, label: bytes, i: int, x: int, bits: int) -> int:
        salt = hashlib.blake2b(label + x.to_bytes((bits + 7) // 8 + 1, "big"), key=self.key, person=bytes([i])).digest()
        out = b"".join(hashlib.blake2b(salt + k.to_bytes(4, "big")).digest() for k in range(bits // 512 + 1))
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _walk(self, label: bytes, x: int, n: int, back: bool) -> int:
        """A balanced network over the next even number of bits, walked until the value is in range."""
        half = ((n - 1).bit_length() + 1) // 2 or 1
        mask = (1 << half) - 1
        order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        while True:
            a, b = x >> half, x & mask
            for i in order:
                if back:
                    a, b = b ^ self._round(label, i, a, half), a
                else:
                    a, b = b, a ^ self._round(label, i, b, half)
            x = a << half | b
            if x < n:
                return x

    def moved(self, label: bytes, x: int, n: int) -> int:
        """Another number below n: one step along a keyed cycle of all of them."""
        return x if n < 2 else self._walk(label, (self._walk(label, x, n, False) + 1) % n, n, True)

    def letters(self, kind: str, text: str, alphabets=ALPHABET_OF) -> str:
        """The text with its letters and digits moved within their alphabets.

        Each piece has a permutation that depends on the pieces before it, so the whole is one to one as well.
        """
        if len(text) > PIECE:
            out, before = [], hashlib.blake2b()
            for i in range(0, len(text), PIECE):
                piece = text[i:i + PIECE]
                out.append(self.letters(f"{kind}\x02{before.hexdigest()}", piece, alphabets))
                before.update(piece.encode("utf-8", "surrogatepass"))
            return "".join(out)
        form = [alphabets.get(c) for c in text]
        n, x = 1, 0
        for c, a in zip(text, form, strict=True):
            if a:
                x, n = x * len(a) + a.index(c), n * len(a)
        shape = "\x00".join(a[0] if a else c for c, a in zip(text, form, strict=True))
        x = self.moved(f"{kind}\x01{shape}".encode("utf-8", "surrogatepass"), x, n)
        out = list(text)
        for i in range(len(text) - 1, -1, -1):
            if form[i]:
                x, d = divmod(x, len(form[i]))
                out[i] = form[i][d]
        return "".join(out)

    def digits(self, kind: str, digits: str) -> str:
        return str(self.moved(f"{kind}\x01{len(digits)}".encode(), int(digits), 10 ** len(digits))).zfill(len(digits))

    def of(self, kind: str, value: str) -> str:
        return self._called(value) if kind == "name" else getattr(self, f"_{kind}")(value)

    def _email(self, value: str) -> str:
        low = value.lower() if len(value.lower()) == len(value) else value
        local, _, domain = low.partition("@")
        new = self.letters("email", f"{local}@{domain}")
        return "".join(n.upper() if v.isupper() and len(n.upper()) == 1 else n for n, v in zip(new, value, strict=True)) + ".example"

    def _secret(self, value: str) -> str:
        if len(value) >= 16 and all(c in HEX for c in value):
            return self.letters("hex", value, dict.fromkeys(HEX, HEX))
        return self.letters("secret", value)

    def _ip(self, value: str) -> str:
        x = 0
        for part in value.split("."):
            x = x << 8 | int(part)
        x = self.moved(b"ip", x, 1 << 32)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def _ip6(self, value: str) -> str:
        return str(ipaddress.IPv6Address(self.moved(b"ip6", int(ipaddress.IPv6Address(value)), 1 << 128)))

    def _iban(self, value: str) -> str:
        flat = value.replace(" ", "")
        return refill(value, flat[:2] + self.letters("iban", flat[2:]), str.isalnum)

    def _ssn(self, value: str) -> str:
        return refill(value, self.digits("ssn", "".join(filter(str.isdigit, value))), str.isdigit)

    def _phone(self, value: str) -> str:
        code = re.match(r"\+(?:1|7|[2-9]\d{1,2}?(?=[ .(-])|[2-9]\d)|\(?0[1-9]", value)
        head = code[0] if code else ""
        rest = value[len(head):]
        return head + refill(rest, self.digits(f"phone{head.strip('(')}", "".join(filter(str.isdigit, rest))), str.isdigit)

    def _card(self, value: str) -> str:
        digits = "".join(filter(str.isdigit, value))
        if luhn(digits):
            body = self.digits("card", digits[:-1])
            new = body + next(d for d in DIGITS if luhn(body + d))
        else:
            new = self.digits("number", digits)
            while luhn(new):  # stay among those without a checksum
                new = self.digits("number", new)
        return refill(value, new, str.isdigit)

    def _person(self, value: str) -> str:
        title, gap, name = re.match(r"(\S+?\.?)([ \u00a0])(.*)", value, re.S).groups()
        gender = next((g for g, v in TITLES.items() if title.rstrip(".").capitalize() in v.split()), "x")
        parts = re.split(r"([ \u00a0-])", name)
        return title + gap + "".join(p if i % 2 else self._name(gender, p) for i, p in enumerate(parts))

    def _mention(self, value: str) -> str:
        return self._name("x", value)

    def _called(self, value: str) -> str:
        """A name without a title."""
        return "".join(p if i % 2 else self._name("x", p) for i, p in enumerate(re.split(r"([ \u00a0-])", value)))

    def _name(self, gender: str, part: str) -> str:
        if part.islower():
            return self._name(gender, part.capitalize()).lower()
        g = GENDER_OF.get(part)
        if g:
            names = GIVEN[g].split()
            return names[self.moved(f"given-{g}".encode(), names.index(part), len(names))]
        new = self.letters("name", part, NAME_ALPHABET_OF)
        while new in GENDER_OF or new == part:  # given names have a permutation of their own
            new = self.letters("name", new, NAME_ALPHABET_OF)
        return new


def refill(form: str, characters: str, which: Callable[[str], bool]) -> str:
    """``form`` with its characters of one sort replaced in turn."""
    new = iter(characters)
    return "".join(next(new) if which(c) else c for c in form)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def rewritten(text: str, surrogates: Surrogates, memo: dict) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each entity."""
    out, at, used = [], 0, []
    for start, end, kind in entities(text):
        value = text[start:end]
        new = memo.get((kind, value))
        if new is None:
            if len(memo) > 100_000:
                memo.clear()
            new = memo[kind, value] = surrogates.of(kind, value)
        out += (text[at:start], new)
        at = end
        used.append((kind, value, new))
    return ("".join([*out, text[at:]]) if used else text), used


def _run(docs: DataFrame, key: str, schema, row) -> DataFrame:
    ready(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates, memo = Surrogates(key), {}
        at = names.index("text")
        for batch in slices(batches, "text"):
            yield from row(batch, at, [None if t is None else rewritten(t, surrogates, memo) for t in batch.column(at).to_pylist()])

    return docs.mapInArrow(run, schema)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """The same rows and columns with surrogates in ``text`` (and ``n_chars`` after it, where there is one)."""
    names = docs.columns

    def row(batch, at, done):
        columns = list(batch.columns)
        columns[at] = pa.array([None if d is None else d[0] for d in done], pa.string())
        if "n_chars" in names:
            i = names.index("n_chars")
            old = columns[i].to_pylist()
            columns[i] = pa.array([len(d[0]) if d and d[1] else o for d, o in zip(done, old, strict=True)], columns[i].type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    # Any column name can pass, one with a dot too.
    plain = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(names)])
    return _run(plain, key, plain.schema, row).toDF(*names)


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_entities, kinds (sorted, comma-joined) of every document; raises if distinctness is broken anywhere."""
    broken = collisions(docs, key).where("fault != 'real'")
    if not broken.isEmpty():
        raise ValueError(f"surrogates are not one to one: {broken.limit(5).collect()}")

    def row(batch, _, done):
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([None if d is None else d[0] for d in done], pa.string()),
            pa.array([len(d[1]) if d else 0 for d in done], pa.int64()),
            pa.array([",".join(sorted({k for k, _, _ in d[1]})) if d else "" for d in done], pa.string())],
            names=["doc_id", "text", "n_entities", "kinds"])

    return _run(text_input(docs, "doc_id", "text"), key, "doc_id long, text string, n_entities long, kinds string", row)


def mapping(docs: DataFrame, key: str) -> DataFrame:
    """kind, entity, surrogate: every distinct entity of the corpus."""
    def row(batch, _, done):
        used = sorted({u for d in done if d for u in d[1]})
        yield pa.RecordBatch.from_arrays([pa.array([u[i] for u in used], pa.string()) for i in range(3)], names=["kind", "entity", "surrogate"])

    return _run(text_input(docs, "doc_id", "text"), key, "kind string, entity string, surrogate string", row).distinct()


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """fault, kind, surrogate: ``shared`` if it stands for two entities, ``unchanged`` if for itself (neither by
    construction), ``real`` if another entity of the corpus happens to read like it.

    Ways of writing one entity differ in case and separators only, and so do their surrogates.
    """
    found = stage(mapping(docs, key), "surrogates")
    same = found.groupBy("kind", "surrogate").agg(F.count_distinct("entity").alias("n")).where("n > 1")
    real = found.where("entity != surrogate").join(found.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_semi")
    faults = (("shared", same), ("unchanged", found.where("entity = surrogate")), ("real", real))
    parts = [df.select(F.lit(name).alias("fault"), "kind", "surrogate") for name, df in faults]
    return parts[0].union(parts[1]).union(parts[2])
