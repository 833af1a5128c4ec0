"""Queries of the training-data operators and the pipeline; SQL where it can express them."""

from __future__ import annotations

import importlib

_MODULES = ["quality_knn", "line_dedup", "simhash_bytes", "toxicity_bigru", "pstable_mips", "quotes", "bmw_search", "suffix_dedup", "sp_sampling", "packing_nnls", "word_runs", "spelling_trie", "rotated_codes"]


def _load():
    qs, sql = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(f"sparkwright.llm.{name}")
        qs.update(mod.QUERIES)
        sql.update(getattr(mod, "ORACLE", {}))
    return qs, sql


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
