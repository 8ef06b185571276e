"""Command line: the user-facing jobs against a store folder.

    python -m tidepool open   STORE [--dim N]
    python -m tidepool import STORE FILE...      (JSONL; prints the report)
    python -m tidepool embed  STORE [--fail-stop]
    python -m tidepool search STORE TEXT... [--k 20]
    python -m tidepool export STORE OUT [--one-file]
    python -m tidepool change STORE CHANGES_JSONL (id, op insert/update/delete, instruction, input, output, source;
                                                   later lines win)
    python -m tidepool list   STORE
    python -m tidepool stream STORE IN_DIR CHECKPOINT_DIR   (import every file that has arrived)
    python -m tidepool ledger STORE              (the report of each import)
    python -m tidepool compact STORE

The bundled embedder is the letter histogram (26 dimensions). ``--embedder MODULE:FUNCTION`` names
another one for import, embed, search and stream: a function of the module, which the workers
can import, from RecordBatch(id, text) to RecordBatch(id, v, error). The store's dimension must be its own.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    # spark-submit's master and settings hold; plain Python runs locally.
    return SparkSession.builder.appName("tidepool").getOrCreate()


def _embedder(name: str):
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tidepool")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("open"); p.add_argument("store"); p.add_argument("--dim", type=int, default=26)
    p = sub.add_parser("import"); p.add_argument("store"); p.add_argument("files", nargs="+")
    p = sub.add_parser("embed"); p.add_argument("store"); p.add_argument("--fail-stop", action="store_true")
    p = sub.add_parser("search"); p.add_argument("store"); p.add_argument("text", nargs="+")
    p.add_argument("--k", type=int, default=20)
    p = sub.add_parser("export"); p.add_argument("store"); p.add_argument("out"); p.add_argument("--one-file", action="store_true")
    p = sub.add_parser("change"); p.add_argument("store"); p.add_argument("changes")
    p = sub.add_parser("list"); p.add_argument("store")
    p = sub.add_parser("stream"); p.add_argument("store"); p.add_argument("inbox"); p.add_argument("checkpoint")
    p = sub.add_parser("ledger"); p.add_argument("store")
    p = sub.add_parser("compact"); p.add_argument("store")
    for name in ("import", "embed", "search", "stream"):
        sub.choices[name].add_argument("--embedder", default="tidepool.operators.embed:letter_histogram")
    a = ap.parse_args(argv)

    from tidepool.operators.embed import FAIL_STOP, PER_ROW
    from tidepool.plans import jobs
    from tidepool.sources.store import Store, listing

    spark = _session()
    store = Store(spark, a.store)
    own = {"embedder": _embedder(a.embedder)} if "embedder" in a else {}
    if a.cmd == "open":
        jobs.open_store(store, a.dim)
        print(store.current())
    elif a.cmd == "import":
        store.create(26)
        print(jobs.import_jsonl(store, a.files, **own).first().asDict())
    elif a.cmd == "embed":
        print(jobs.embed_store(store, mode=FAIL_STOP if a.fail_stop else PER_ROW, **own).first().asDict())
    elif a.cmd == "search":
        q = spark.createDataFrame([(0, " ".join(a.text))], "qid long, text string")
        for r in jobs.search_store(store, q, k=a.k, **own).orderBy("rank").collect():
            print(f"{r['rank']:3d}  {r['score']:.3f}  id={r['id']}")
    elif a.cmd == "export":
        print(jobs.export_store(store, a.out, a.one_file), "records written")
    elif a.cmd == "change":
        from tidepool.sources.jsonl import read_changes

        jobs.change_store(store, read_changes(spark, a.changes), order_col="line_order", trim_newlines=True)
        print(store.current())
    elif a.cmd == "list":
        for r in listing(store.records()).toLocalIterator():
            print(r["id"], r["instruction_preview"], "|", r["output_preview"])
    elif a.cmd == "stream":
        from tidepool.streaming.incremental import import_stream

        store.create(26)
        import_stream(store, a.inbox, a.checkpoint, **own)
        print(store.current())
    elif a.cmd == "ledger":
        for r in store.ledger().orderBy("stream", "batch_id").toLocalIterator():
            print(r.asDict())
    elif a.cmd == "compact":
        print(store.compact())
    return 0


if __name__ == "__main__":
    sys.exit(main())
