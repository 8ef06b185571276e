"""DuckDB SQL for the operators that SQL can express on small tables: plain all-pairs forms, by no index."""

from __future__ import annotations

from tidepool.llm import bottomk, decontaminate, jaccard_join, phrase_dedup, spelling, suffix_dedup

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str, low: bool = True) -> str:
    text = "coalesce(text, '')"
    return f"regexp_extract_all({f'translate({text}, {_UPPER!r}, {_LOWER!r})' if low else text}, '{pattern}')"


def components(percent: int, shingle: int, kept: bool) -> str:
    """Sets of word shingles, all pairs with a shingle in common, and what they reach."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_words(SPACED)} AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i:i + {shingle} - 1], ' '))) END AS sh FROM d),
e AS (SELECT r, unnest(sh) AS t, len(sh) AS n FROM s),
p AS (SELECT a.r AS x, b.r AS y FROM e a JOIN e b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n
  HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT r AS x, r AS y FROM s UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN s ON s.r = reach.y GROUP BY x)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id{', doc_id = component_id AS kept' if kept else ''} FROM s JOIN c ON c.x = s.r"""


def contamination(window: int) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words(ALNUM)} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_words(ALNUM)} AS w, least({window}, len(w)) AS n FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i WHERE n > 0)),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS t FROM
  (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS k FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT r, n, k, item FROM dw JOIN iw USING (n, t)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)"""


def phrases(n: int) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words(SPACED, False)} AS w FROM documents),
x AS (SELECT r, doc_id, k, array_to_string(w[k:k + {n} - 1], ' ') AS t FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - {n} + 2, 1))) AS k FROM d)),
o AS (SELECT r, k, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS nth FROM x),
g AS (SELECT DISTINCT r, unnest(range(k, k + {n})) AS p FROM o WHERE nth > 1),
u AS (SELECT r, w[p] AS word, p FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM u ANTI JOIN g USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS gone FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""


def byte_strings(n: int) -> str:
    """Bytes as pairs of hexadecimal digits; strings are counted by a 64-bit hash."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS size FROM documents),
x AS (SELECT r, k, hash(substr(h, 2 * k + 1, 2 * {n})) AS t FROM (SELECT r, h, unnest(range(0, greatest(size - {n} + 1, 0))) AS k FROM d)),
m AS (SELECT t FROM x GROUP BY t HAVING count(*) > 1),
hits AS (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS before FROM x SEMI JOIN m USING (t)),
island AS (SELECT r, k, sum(CASE WHEN before IS NULL OR k > before + {n} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k) AS nth FROM hits),
span AS (SELECT r, nth, min(k) AS low, max(k) + {n} AS high FROM island GROUP BY r, nth),
gap AS (SELECT r, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS a, low AS b FROM span
  UNION ALL SELECT r, coalesce(max(high), 0), max(size) FROM d LEFT JOIN span USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS left_over FROM gap JOIN d USING (r) WHERE b > a GROUP BY r),
n AS (SELECT r, sum(high - low) AS gone, count(*) AS spans FROM span GROUP BY r)
SELECT doc_id, size::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(left_over, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""


def variants(min_length: int, min_count: int, slip: int, ratio: int) -> str:
    """Check sums byte by byte from a table; near words by shared one-letter deletions, checked by edit distance."""
    # The edit distance compares bytes, so letters beyond ASCII stand as single bytes that no word holds.
    beyond = "".join(map(chr, range(0xC0, 0x100)))
    single = "".join(chr(c) for c in range(33, 127) if not 97 <= c <= 122 and chr(c) not in "'")[:64]
    assert len(single) == 64
    return f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), {_UPPER!r}, {_LOWER!r}) AS run FROM documents),
found AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {min_length} GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, 'None') || ':' || run, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM found),
sums AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b),
  lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM bytes, tab),
vocabulary AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {slip} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums)
  WHERE length(word) >= {min_length} GROUP BY word HAVING sum(n) >= {min_count}),
keys AS (SELECT word, word AS k FROM vocabulary UNION SELECT word, substr(word, 1, i) || substr(word, i + 2) FROM (SELECT word, unnest(range(length(word))) AS i FROM vocabulary)),
pairs AS (SELECT DISTINCT a.word AS a, b.word AS b FROM keys a JOIN keys b ON a.k = b.k AND a.word <> b.word),
near AS (SELECT a, b FROM pairs WHERE levenshtein(translate(a, '{beyond}', '{single}'), translate(b, '{beyond}', '{single}')) = 1),
ranked AS (SELECT a AS word, b AS other, v.n AS other_n, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS nth, count(*) OVER (PARTITION BY a) AS n_near
  FROM near JOIN vocabulary v ON v.word = near.b),
judged AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {ratio} * v.n THEN other END AS form,
  CASE WHEN other_n >= {ratio} * v.n THEN other_n END AS form_n FROM vocabulary v LEFT JOIN (SELECT * FROM ranked WHERE nth = 1) r ON r.word = v.word),
walk AS (SELECT word, word AS at FROM judged UNION SELECT walk.word, judged.form FROM walk JOIN judged ON judged.word = walk.at WHERE judged.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN judged ON judged.word = walk.at WHERE judged.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)"""


ORACLES = {
    "op4_jaccard_join": components(jaccard_join.PERCENT, jaccard_join.SHINGLE, False),
    "op5_decontaminate": contamination(decontaminate.WINDOW),
    "op8_phrase_dedup": phrases(phrase_dedup.PHRASE_WORDS),
    "op9_suffix_dedup": byte_strings(suffix_dedup.MATCH_BYTES),
    "op11_bottomk": components(bottomk.PERCENT, bottomk.SHINGLE, True),
    "op12_spelling": variants(spelling.MIN_LENGTH, spelling.MIN_COUNT, spelling.SLIP, spelling.RATIO),
}
