"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontaminate", "simhash", "pfor", "crf", "mixing", "langid", "lm", "ann", "licences", "passages")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"quillbin.llm.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
