"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = ("queries_dedup", "queries_toxicity", "queries_decontam", "queries_pii", "queries_packing", "queries_langid", "queries_html", "queries_url", "queries_shards", "queries_search", "queries_fim", "queries_bpe", "queries_treaps")


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"chronofold.llm.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
