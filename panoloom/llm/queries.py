"""Registered queries of this subpackage and their SQL."""

from importlib import import_module

MODULES = ["mixing", "secrets", "toxicity", "near", "decontam", "fingerprint", "urls", "quotes", "licenses", "dedup", "debruijn", "codes", "importance"]


def _merged(attr: str) -> dict:
    out = {}
    for m in MODULES:
        out.update(getattr(import_module(f"panoloom.llm.{m}"), attr, {}))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
