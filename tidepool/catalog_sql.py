"""DuckDB oracle SQL for every registered query that SQL can express.

The fixture definitions repeat ``tidepool.plans.fixtures`` in SQL; each oracle
is one statement over the driver's pre-registered tables.
"""

from __future__ import annotations

from string import ascii_lowercase

from tidepool.schema import WS

_WS = "||".join(f"chr({ord(c)})" for c in WS)
_LB = r"(?:\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])"
_FIXED = "2020-01-01 00:00:00"
_AS_OF = "2021-06-01 12:00:00"
_FAIL_EVERY = 37
_K = 20
_THRESHOLD = 0.93


def _hist(x: str) -> str:
    """Letter histogram of a text (ASCII letters, case folded) as DOUBLE[]."""
    parts = [
        f"(strlen({x}) - strlen(replace(replace({x}, '{c}', ''), '{c.upper()}', '')))::DOUBLE"
        for c in ascii_lowercase
    ]
    return "list_value(" + ", ".join(parts) + ")"


def _nz(v: str) -> str:
    return f"len(list_filter({v}, lambda x: x <> 0)) > 0"


def _cos(a: str, b: str) -> str:
    return (f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * "
            f"sqrt(list_dot_product({b}, {b}))))")


def _preview(x: str) -> str:
    flat = f"regexp_replace(regexp_replace({x}, '{_LB}\\z', ''), '{_LB}', ' ', 'g')"
    return f"(CASE WHEN length({flat}) > 40 THEN substr({flat}, 1, 40) || '…' ELSE {flat} END)"


def _digest(v: str, p: str = "v") -> str:
    return f"len({v}) AS {p}_dim, round(list_sum({v}), 6) AS {p}_sum, {_items(v)} AS {p}_items"


def _items(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: round(x * 1e6)::BIGINT), ',')"


FX = f"""
ws AS (SELECT {_WS} AS w),
fx_src AS (
  SELECT doc_id, doc_id % 40 AS k,
         split_part(text, chr(10), 1) AS instruction,
         CASE WHEN lang = 'en' THEN '' ELSE lang END AS "input",
         CASE WHEN contains(text, chr(10))
              THEN substr(text, length(split_part(text, chr(10), 1)) + 2)
              ELSE '' END AS "output",
         source
  FROM documents),
fx_docs AS (
  SELECT doc_id + 1 AS id, instruction, "input", "output", source
  FROM fx_src WHERE trim("output") <> ''),
fx_store AS (SELECT * FROM fx_docs WHERE (id - 1) % 10 = 0),
fx_all_lines AS (
  SELECT doc_id AS line_no, CASE k
   WHEN 1 THEN '{{broken' || doc_id
   WHEN 2 THEN '[1,2,3]'
   WHEN 3 THEN json_object('instruction', doc_id, 'input', '', 'output', "output")::VARCHAR
   WHEN 4 THEN json_object('instruction', instruction, 'input', "input", 'output', '   ')::VARCHAR
   WHEN 5 THEN json_object('instruction', instruction, 'input', NULL, 'output', "output")::VARCHAR
   WHEN 6 THEN json_object('instruction', instruction, 'input', "input", 'output', "output")::VARCHAR || ' trailing'
   WHEN 7 THEN '   '
   WHEN 8 THEN json_object('instruction', instruction, 'output', "output")::VARCHAR
   WHEN 9 THEN '  ' || json_object('instruction', instruction, 'input', "input", 'output', "output", 'source', source)::VARCHAR || '  '
   WHEN 12 THEN CASE WHEN doc_id % 200 = 12 THEN '{{"instruction":"a","output":"b","x":' || repeat('[', 20000) || repeat(']', 20000) || '}}'
     ELSE json_object('instruction', instruction, 'input', "input", 'output', "output", 'source', source)::VARCHAR END
   WHEN 11 THEN json_object('instruction', chr(12288), 'input', "input", 'output', "output")::VARCHAR
   ELSE json_object('instruction', instruction, 'input', "input", 'output', "output", 'source', source)::VARCHAR
   END AS line
  FROM fx_src),
fx_lines AS (SELECT * FROM fx_all_lines WHERE line_no % 10 <> 0),
fx_vec AS (
  SELECT vec_id * 4 AS id, embedding::DOUBLE[] AS v, 'base' AS kind FROM embeddings
  UNION ALL SELECT vec_id * 4 + 1, list_concat([embedding[1]::DOUBLE + 0.2], embedding[2:]::DOUBLE[]), 'near' FROM embeddings WHERE vec_id % 5 = 0
  UNION ALL SELECT vec_id * 4 + 2, list_concat([embedding[1]::DOUBLE + 0.6], embedding[2:]::DOUBLE[]), 'far' FROM embeddings WHERE vec_id % 5 = 1
  UNION ALL SELECT vec_id * 4 + 3, list_transform(embedding, lambda x: 0.0::DOUBLE), 'zero' FROM embeddings WHERE vec_id % 50 = 2),
fx_records AS (
  SELECT s.id, instruction, "input", "output", source,
     TIMESTAMP '{_FIXED}' AS created_at, TIMESTAMP '{_FIXED}' AS updated_at,
     CASE WHEN (s.id - 1) % 100 = 40 THEN list_transform(e.embedding, lambda x: 0.0::DOUBLE)
          WHEN (s.id - 1) % 20 <> 7 THEN e.embedding::DOUBLE[] END AS embedding
  FROM fx_docs s LEFT JOIN embeddings e ON e.vec_id = s.id - 1),
fx_index AS (
  SELECT id, embedding AS v FROM fx_records
  WHERE (id - 1) % 2 = 0 AND {_nz('embedding')}),
fx_changes AS (
  SELECT id, 'delete' AS op, NULL::VARCHAR AS instruction, NULL::VARCHAR AS "input", NULL::VARCHAR AS "output", NULL::VARCHAR AS source, 1 AS seq FROM fx_records WHERE (id - 1) % 30 = 0
  UNION ALL SELECT id, 'update', '~ ' || instruction || ' (edited)', "input", "output", source, 2 FROM fx_records WHERE (id - 1) % 50 = 10
  UNION ALL SELECT id, 'update', instruction || ' (edited)', "input", "output", source, 3 FROM fx_records WHERE (id - 1) % 50 = 10
  UNION ALL SELECT -1, 'delete', NULL, NULL, NULL, NULL, 1
  UNION ALL SELECT -2, 'update', 'x', '', 'y', '', 2),
fx_new_vec AS (
  SELECT r.id, CASE WHEN r.id % 4 = 3 THEN list_transform(e.embedding, lambda x: 0.0::DOUBLE)
                    ELSE e.embedding::DOUBLE[] END AS v
  FROM fx_records r JOIN embeddings e ON e.vec_id = r.id)
"""

CLS = """
fx_nb AS (SELECT line_no, trim(line, w) AS line FROM fx_lines, ws WHERE trim(line, w) <> ''),
fx_cls AS (SELECT line_no, line, CASE
    WHEN contains(line, repeat('[', 2001)) THEN 'malformed' -- nested deeper than 2,000 levels
    WHEN NOT json_valid(line) THEN 'malformed'
    WHEN json_type(line) <> 'OBJECT' THEN 'not_object'
    WHEN coalesce(json_type(line, '$.instruction'), 'VARCHAR') <> 'VARCHAR'
      OR coalesce(json_type(line, '$.input'), 'VARCHAR') <> 'VARCHAR'
      OR coalesce(json_type(line, '$.output'), 'VARCHAR') <> 'VARCHAR'
      OR coalesce(json_type(line, '$.source'), 'VARCHAR') <> 'VARCHAR' THEN 'bad_type'
    WHEN trim(coalesce(line->>'$.instruction', ''), w) = ''
      OR trim(coalesce(line->>'$.output', ''), w) = '' THEN 'blank_required'
    ELSE 'valid' END AS status FROM fx_nb, ws),
fx_valid AS (SELECT line_no, coalesce(line->>'$.instruction', '') AS instruction, coalesce(line->>'$.input', '') AS "input",
    coalesce(line->>'$.output', '') AS "output", coalesce(line->>'$.source', '') AS source FROM fx_cls WHERE status = 'valid'),
fx_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instruction, "input", "output" ORDER BY line_no) AS rn FROM fx_valid) v WHERE rn = 1)
"""
CLS_ALL = CLS.replace("FROM fx_lines", "FROM fx_all_lines")


def _import_ctes(empty_store: bool) -> str:
    if empty_store:
        new = "fx_new AS (SELECT * FROM fx_first)"
        base = "0"
        pool_store = ""
    else:
        new = ("fx_new AS (SELECT * FROM fx_first v WHERE NOT EXISTS (SELECT 1 FROM fx_store s WHERE "
               "s.instruction = v.instruction AND s.\"input\" = v.\"input\" AND s.\"output\" = v.\"output\"))")
        base = "(SELECT max(id) FROM fx_store)"
        pool_store = f"SELECT id, {_hist('instruction || \"input\"')} AS v FROM fx_store UNION ALL "
    return f""",
{new},
fx_added AS (SELECT *, {base} + row_number() OVER (ORDER BY line_no) AS id FROM fx_new),
pool AS ({pool_store}SELECT id, {_hist('instruction || "input"')} AS v FROM fx_added),
nz AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS nv FROM pool WHERE list_dot_product(v, v) > 0),
newv AS (SELECT * FROM nz WHERE id IN (SELECT id FROM fx_added)),
near AS (SELECT q.id, max(list_dot_product(q.v, p.v) / (q.nv * p.nv)) AS s
         FROM newv q JOIN nz p ON p.id < q.id GROUP BY q.id)
"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts if p.strip()) + "\n"


_IMPORT = _with(FX, CLS + _import_ctes(False))
_BOOT = _with(FX, CLS_ALL + _import_ctes(True))

_REPORT = """SELECT (SELECT count(*) FROM fx_added) AS added,
       (SELECT count(*) FROM fx_valid) - (SELECT count(*) FROM fx_added) AS duplicate,
       (SELECT count(*) FROM fx_cls WHERE status <> 'valid') AS invalid,
       (SELECT count(*) FROM near WHERE s >= {t}) AS near_duplicate""".format(t=_THRESHOLD)

_W = _with(FX)


def _topk(q: str, x: str) -> str:
    return f"""{_W.rstrip()},
q AS ({q}), x AS ({x}),
s AS (SELECT q.id AS qid, x.id, {_cos('q.v', 'x.v')} AS score FROM q, x)
SELECT qid, rank, id, round(score, 6) AS score FROM (
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
WHERE rank <= {_K}"""


_ORACLES = {
    "import_report": _IMPORT + _REPORT,
    "incremental_ledger": _IMPORT + _REPORT,
    "jsonl_lines": _W + """SELECT line_no, line FROM (
  SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, trim(line, w) AS line FROM fx_all_lines, ws)
WHERE line <> ''""",
    "jsonl_line_status": _with(FX, CLS_ALL) + "SELECT line_no, status FROM fx_cls",
    "import_status": _IMPORT + """SELECT c.line_no, CASE WHEN c.status <> 'valid' THEN c.status
  WHEN a.line_no IS NOT NULL THEN 'added' ELSE 'duplicate' END AS status
FROM fx_cls c LEFT JOIN fx_added a ON a.line_no = c.line_no""",
    "import_records": _IMPORT + 'SELECT line_no, instruction, "input", "output", source FROM fx_added',
    "import_duplicates": _IMPORT + "SELECT line_no FROM fx_valid WHERE line_no NOT IN (SELECT line_no FROM fx_added)",
    "import_assigned_ids": _IMPORT + "SELECT line_no, id FROM fx_added",
    "import_near_duplicates": _IMPORT + f"SELECT id, round(s, 6) AS score FROM near WHERE s >= {_THRESHOLD}",
    "bootstrap_import": _BOOT + _REPORT,
    "incremental_import": _IMPORT + """SELECT id, instruction, "input", "output", source FROM fx_store
UNION ALL SELECT id, instruction, "input", "output", source FROM fx_added""",
    "existing_keys": _W + 'SELECT DISTINCT instruction, "input", "output" FROM fx_docs',
    "record_listing": _W + f"""SELECT id, {_preview('instruction')} AS instruction_preview,
  {_preview('"output"')} AS output_preview FROM fx_docs""",
    "preview": f"SELECT doc_id, {_preview('text')} AS preview FROM documents",
    "record_lookup": _W + """SELECT id, instruction, "input", "output", source,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
  embedding IS NOT NULL AS has_embedding
FROM fx_records WHERE id IN (SELECT id FROM fx_changes)""",
    "schema_migration": _W + f"""SELECT id, instruction, "input", "output", '' AS source,
  '{_FIXED}' AS created_at, '{_FIXED}' AS updated_at, true AS pending FROM fx_docs""",
    "vector_backfill": _W + f"""SELECT id, {_digest('v')} FROM (
  SELECT id, v FROM fx_index
  UNION ALL SELECT id, embedding FROM fx_records
  WHERE embedding IS NOT NULL AND {_nz('embedding')} AND id NOT IN (SELECT id FROM fx_index))""",
    "pending_records": _W + 'SELECT id, instruction, "input" FROM fx_records WHERE embedding IS NULL',
    "embedding_text": _W + """SELECT id, CASE WHEN trim("input", w) <> ''
  THEN trim(instruction, w) || chr(10) || chr(10) || trim("input", w) ELSE trim(instruction, w) END AS text
FROM fx_records, ws""",
    "nonzero_vectors": _W + f"SELECT id FROM fx_vec WHERE {_nz('v')}",
    "update_records": _W.rstrip() + f""",
ch AS (SELECT fx_changes.* FROM fx_changes, ws WHERE op = 'update'
       AND trim(instruction, w) <> '' AND trim("output", w) <> ''
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT r.id,
  CASE WHEN ch.id IS NULL THEN r.instruction ELSE coalesce(ch.instruction, '') END AS instruction,
  CASE WHEN ch.id IS NULL THEN r."input" ELSE coalesce(ch."input", '') END AS "input",
  CASE WHEN ch.id IS NULL THEN r."output" ELSE coalesce(ch."output", '') END AS "output",
  CASE WHEN ch.id IS NULL THEN r.source ELSE coalesce(ch.source, '') END AS source,
  CASE WHEN ch.id IS NULL THEN '{_FIXED}' ELSE '{_AS_OF}' END AS updated_at,
  CASE WHEN ch.id IS NULL THEN r.embedding IS NOT NULL ELSE false END AS has_embedding,
  (ch.id IS NULL AND r.id IN (SELECT id FROM fx_index)) AS has_vec
FROM fx_records r LEFT JOIN ch ON ch.id = r.id""",
    "delete_records": _W + """SELECT id, instruction, "input", "output", source,
  strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, embedding IS NOT NULL AS has_embedding,
  id IN (SELECT id FROM fx_index) AS has_vec FROM fx_records
WHERE id NOT IN (SELECT id FROM fx_changes WHERE op = 'delete')""",
    "apply_changes": _W.rstrip() + f""",
ch AS (SELECT fx_changes.* FROM fx_changes, ws WHERE op = 'update'
       AND trim(instruction, w) <> '' AND trim("output", w) <> ''
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT r.id,
  CASE WHEN ch.id IS NULL THEN r.instruction ELSE coalesce(ch.instruction, '') END AS instruction,
  CASE WHEN ch.id IS NULL THEN r."input" ELSE coalesce(ch."input", '') END AS "input",
  CASE WHEN ch.id IS NULL THEN r."output" ELSE coalesce(ch."output", '') END AS "output",
  CASE WHEN ch.id IS NULL THEN r.source ELSE coalesce(ch.source, '') END AS source,
  CASE WHEN ch.id IS NULL THEN '{_FIXED}' ELSE '{_AS_OF}' END AS updated_at,
  CASE WHEN ch.id IS NULL THEN r.embedding IS NOT NULL ELSE false END AS has_embedding,
  (ch.id IS NULL AND r.id IN (SELECT id FROM fx_index)) AS has_vec
FROM fx_records r LEFT JOIN ch ON ch.id = r.id
WHERE r.id NOT IN (SELECT id FROM fx_changes WHERE op = 'delete')""",
    "save_embeddings": _W.rstrip() + f""",
nv AS (SELECT * FROM fx_new_vec WHERE id IN (SELECT id FROM fx_records)),
vecs AS (SELECT id FROM fx_index WHERE id NOT IN (SELECT id FROM nv)
         UNION ALL SELECT id FROM nv WHERE {_nz('v')})
SELECT r.id, {_digest('coalesce(nv.v, r.embedding)', 'emb')},
  r.id IN (SELECT id FROM vecs) AS has_vec
FROM fx_records r LEFT JOIN nv ON nv.id = r.id""",
    "upsert_vectors": _W + f"""SELECT id, {_digest('v')} FROM (
  SELECT id, v FROM fx_index WHERE id NOT IN (SELECT id FROM fx_new_vec)
  UNION ALL SELECT id, v FROM fx_new_vec WHERE {_nz('v')})""",
    "clear_vectors": _W + f"""SELECT id, {_digest('v')} FROM fx_index
WHERE id NOT IN (SELECT id FROM fx_changes WHERE op = 'delete')""",
    "vector_codec": f"""SELECT vec_id, len(embedding) AS dim, true AS roundtrip_ok,
  {_items('embedding::DOUBLE[]')} AS items FROM embeddings""",
    "cosine_pairs": _W + f"""SELECT a.id AS a, b.id AS b,
  round(CASE WHEN list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0
        THEN {_cos('a.v', 'b.v')} END, 6) AS score
FROM fx_vec a JOIN fx_vec b ON a.kind <> 'base' AND b.kind = 'base' AND a.id - a.id % 4 = b.id""",
    "score_format": _W + f"""SELECT a.id AS a, b.id AS b,
  printf('%.3f', CASE WHEN list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0
        THEN {_cos('a.v', 'b.v')} END) AS score_text
FROM fx_vec a JOIN fx_vec b ON a.kind <> 'base' AND b.kind = 'base' AND a.id - a.id % 4 = b.id""",
    "trim_trailing_newlines": "SELECT doc_id, rtrim(text, chr(10)) AS value FROM documents",
    "cosine_top_k": _topk(f"SELECT id, v FROM fx_vec WHERE id = 1 AND {_nz('v')}",
                          f"SELECT id, v FROM fx_vec WHERE {_nz('v')}"),
    "cosine_top_k_batch": _topk(f"SELECT id, v FROM fx_vec WHERE kind IN ('near', 'far') AND {_nz('v')}",
                                f"SELECT id, v FROM fx_vec WHERE kind = 'base' AND {_nz('v')}"),
    "max_similarity": _W.rstrip() + f""",
q AS (SELECT id, v FROM fx_vec WHERE id % 8 >= 4),
x AS (SELECT id, v FROM fx_vec WHERE id % 8 < 4 AND {_nz('v')})
SELECT q.id, round(coalesce(max(CASE WHEN {_nz('q.v')} THEN {_cos('q.v', 'x.v')} END), 0.0), 6) AS score
FROM q LEFT JOIN x ON true GROUP BY q.id""",
    "near_duplicates": _W.rstrip() + f""",
e AS (SELECT * FROM fx_vec WHERE {_nz('v')}),
n AS (SELECT * FROM e WHERE id % 8 <> 0),
p AS (SELECT n.id, max({_cos('n.v', 'e.v')}) AS s FROM n
      JOIN e ON e.id % 8 = 0 OR e.id < n.id GROUP BY 1)
SELECT id, round(s, 6) AS score FROM p WHERE s >= {_THRESHOLD}""",
    "embed_records": _W.rstrip() + f""",
h AS (SELECT id, {_hist('instruction || "input"')} AS v FROM fx_records WHERE embedding IS NULL)
SELECT id, {_digest('v')}, list_dot_product(v, v) AS v_sq FROM h""",
    "search_by_text": _topk(
        f"SELECT item_id AS id, v FROM (SELECT item_id, {_hist('text')} AS v FROM benchmark, ws "
        f"WHERE trim(text, w) <> '') WHERE {_nz('v')}",
        f"SELECT id, v FROM (SELECT id, {_hist('instruction || \"input\"')} AS v FROM fx_docs) WHERE {_nz('v')}",
    ),
    "embed_fail_stop": _W + f"""SELECT id, id < coalesce((SELECT min(id) FROM fx_docs WHERE id % {_FAIL_EVERY} = 0),
  9223372036854775807) AS embedded FROM fx_docs""",
    "embed_report": _W + f"""SELECT count(*) FILTER (WHERE id % {_FAIL_EVERY} <> 0) AS succeeded,
  count(*) AS total FROM fx_docs""",
    "export_roundtrip": _W + """SELECT row_number() OVER (ORDER BY id) - 1 AS line_no,
  instruction, "input", "output", source FROM fx_records""",
}


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
