"""The SQL forms against plain Python, on the smallest tables and on awkward rows."""

from __future__ import annotations

import duckdb
import pytest

from tests.llm import brute, cases, test_bottomk, test_spelling
from tidepool.llm import oracles

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")
EXPECTED = {
    "op4_jaccard_join": lambda docs, _: brute.components(docs), "op5_decontaminate": brute.decontaminate,
    "op8_phrase_dedup": lambda docs, _: brute.repeated_phrases(docs), "op9_suffix_dedup": lambda docs, _: brute.repeated_bytes(docs),
    "op11_bottomk": lambda docs, _: test_bottomk.components(docs), "op12_spelling": lambda docs, _: test_spelling.brute(docs),
}


@pytest.mark.parametrize("name", oracles.ORACLES)
@pytest.mark.parametrize("odd", [False, True])
def test_sql(name, odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{cases.SF}/benchmark.parquet'")
    if odd:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", [(d, t) for d, t in cases.ODD if "\x00" not in (t or "")] + [(40 + i, "varied words " * i) for i in range(1, 9)])
    else:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{cases.SF}/documents.parquet'")
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert cases.ordered(con.execute(oracles.ORACLES[name]).fetchall()) == cases.ordered(EXPECTED[name](docs, items))
