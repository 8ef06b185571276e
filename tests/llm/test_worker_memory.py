"""What a Python worker holds while a stage runs and after it: it goes on with the tasks of other stages."""

from __future__ import annotations

import pyarrow as pa
import pytest

from tidepool.llm import bpe, decontaminate
from tidepool.llm.textops import SLICE_BYTES, slices


class Caught:
    """Stands for a table: keeps the function that is to run on its batches."""

    sparkSession = None

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def texts(n: int, words: int) -> pa.RecordBatch:
    rows = [" ".join(f"w{i}x{j}" for j in range(words)) for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(rows, pa.string())], names=["doc_id", "text"])


@pytest.mark.parametrize("form", [bpe.encode, bpe.digests])
def test_bpe_memo_ends_with_its_task(form, monkeypatch):
    monkeypatch.setattr(bpe, "ready", lambda spark: None)
    monkeypatch.setattr(bpe, "text_input", lambda docs, *columns: docs)
    coder = bpe.load(bpe.default_vocabulary())
    task = form(Caught()).run(iter([texts(3, 20)]))
    first = next(task)
    assert first.num_rows == 3 and len(coder) > 0
    assert [*task] == [] and len(coder) == 0


def test_decontamination_looks_at_bounded_text(monkeypatch):
    batch, seen = texts(400, 1500), []
    assert batch.column(1).nbytes > 3 * SLICE_BYTES
    words_of = decontaminate.words_of
    passage = batch.column(1)[7].as_py()[:200].rsplit(" ", 1)[0]
    sent = type("Sent", (), {"value": decontaminate.Queries(["a"], pa.array([passage]), 10)})
    monkeypatch.setattr(decontaminate, "words_of", lambda column: seen.append(sum(len(t) for t in column.to_pylist())) or words_of(column))
    flags = [f for _, kept in decontaminate.without(sent)(iter([batch])) for f in kept.to_pylist()]
    assert max(seen) <= SLICE_BYTES
    assert [i for i, f in enumerate(flags) if not f] == [7]


def test_slices_give_every_row_once():
    batch = texts(300, 900)
    parts = [*slices(iter([batch, batch.slice(0, 0), batch]), "text")]
    assert len(parts) > 2 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch, batch]))
