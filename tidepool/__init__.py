"""tidepool: a Spark-native curation engine for instruction-tuning records.

The user-facing names are loaded on first use, so Python workers that import
the package for a kernel do not import the job modules::

    from tidepool import Store, import_jsonl, embed_store, search_store
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_EXPORTS = {
    "Store": "tidepool.sources.store",
    "import_jsonl": "tidepool.plans.jobs",
    "import_lines": "tidepool.plans.jobs",
    "bootstrap_import": "tidepool.plans.jobs",
    "open_store": "tidepool.plans.jobs",
    "embed_store": "tidepool.plans.jobs",
    "embed_pending": "tidepool.plans.jobs",
    "search_store": "tidepool.plans.jobs",
    "search": "tidepool.plans.jobs",
    "change_store": "tidepool.plans.jobs",
    "export_store": "tidepool.plans.jobs",
    "import_stream": "tidepool.streaming.incremental",
    "top_k": "tidepool.operators.similarity",
    "max_similarity": "tidepool.operators.similarity",
    "near_duplicates": "tidepool.operators.similarity",
    "embed": "tidepool.operators.embed",
    "letter_histogram": "tidepool.operators.embed",
    "local_session": "tidepool.session",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(f"module 'tidepool' has no attribute {name!r}")
