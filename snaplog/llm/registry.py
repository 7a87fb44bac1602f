"""The subpackage's queries and SQL, for the entry module."""

from __future__ import annotations

from . import fingerprints, mixing, ngram_join, packing, secrets, suffix_dedup, tokenfiles, topk, toxicity, urlfilter

MODULES = (secrets, topk, packing, tokenfiles, toxicity, fingerprints, urlfilter, mixing, ngram_join, suffix_dedup)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
