"""Queries over the test tables, each with the same query as DuckDB SQL."""

from . import chat, documents, feedback, parts, retrieval, streams, tables

_MODULES = (tables, documents, parts, retrieval, feedback, chat, streams)


def all_queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
