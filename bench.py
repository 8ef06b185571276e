"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query result is fully computed with the no-op sink (every column, no
collect to the driver). A warm-up pass over the sf0.001 tables starts the JVM,
the Python workers and code generation first, so timings are of the queries,
not of start-up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "import_report",        # J-IMPORT: parse, dedupe, ids, embed, near-duplicates
    "import_status",
    "jsonl_lines",          # S1 file scan + exact line numbers
    "near_duplicates",      # J5 order-aware theta join
    "max_similarity",       # A2
    "cosine_top_k",         # T2
    "cosine_top_k_batch",   # T4 (blocked plan)
    "search_by_text",       # J-SEARCH
    "embed_records",        # X1
    "apply_changes",        # J-CHANGE
    "save_embeddings",      # W5/W6
    "vector_backfill",      # E2
    "existing_keys",        # A3
    "record_listing",       # S4 + F3
    "preview",              # F3 over whole documents
    "export_roundtrip",     # K1 + S2
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidepool import catalog
    from tidepool.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        # JVM / code-generation warm-up on the smallest tables only.
        for name in HEADLINE:
            catalog.QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    timings = {}
    t0 = time.perf_counter()
    catalog.prepare(spark, sf_dir)  # the stores the operators act on; not in the total
    setup = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        catalog.reset_cache()
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "setup_fixture_stores": setup,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
