"""Registered queries and their SQL."""

from importlib import import_module

MODULES = ["jobs_plan", "raster_plan", "match_plan", "fold_plan", "stitch_plan", "stream_plan", "score_plan"]


def _merged(attr: str) -> dict:
    out = {}
    for m in MODULES:
        out.update(getattr(import_module(f"panoloom.plans.{m}"), attr))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
