"""Operators for training-data corpora and their registered queries."""

from . import alignment, contamination, exact_dedup, language, licenses, manifest, mixing, quality, secrets, simhash, suffix_dedup, token_files, toxicity

_MODULES = (alignment, contamination, exact_dedup, language, licenses, manifest, mixing, quality, secrets, simhash, suffix_dedup, token_files, toxicity)


def llm_queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def llm_oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
