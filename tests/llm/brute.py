"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACED = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})


def lower(text):
    return (text or "").translate(UPPER)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def license_base(text):
    w = ALNUM.findall(lower(text))
    hits = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        hits += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def quality_base(text):
    text = text or ""
    w = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated),
            len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def decontaminate(docs, items):
    windows = {}
    for item, text in items:
        w = tuple(ALNUM.findall(lower(text)))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(w[i:i + n], set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = tuple(ALNUM.findall(lower(text)))
        hit, found = set(), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if w[i:i + n] in known:
                    hit.update(range(i, i + n))
                    found |= known[w[i:i + n]]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def components(docs):
    sets = []
    for doc, text in docs:
        w = SPACED.findall(lower(text))
        sets.append((doc, set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()))
    label = [d for d, _ in sets]
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i][1] and sets[j][1]
             and 100 * len(sets[i][1] & sets[j][1]) >= 90 * len(sets[i][1] | sets[j][1])]
    while changed:
        changed = False
        for i, j in links:
            low = min((x for x in (label[i], label[j]) if x is not None), default=None)
            if (label[i], label[j]) != (low, low):
                label[i] = label[j] = low
                changed = True
    return [(d, len(s), c) for (d, s), c in zip(sets, label)]


def repeated_phrases(docs, n=20):
    """docs: (doc_id, text) with distinct ids that are not null."""
    words = {d: SPACED.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i:i + n]), (d, i))
    out = []
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - n + 1) if first[tuple(w[i:i + n])] != (d, i) for k in range(n)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def repeated_bytes(docs, n=200):
    """docs: (doc_id, text) with distinct ids that are not null."""
    data = {d: (t or "").encode() for d, t in docs}
    places = Counter(b[i:i + n] for b in data.values() for i in range(len(b) - n + 1))
    out = []
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if places[b[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        runs = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out
