"""The queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("license_scan", "sharding", "url_filter", "media", "toxicity", "quality", "langid", "simhash", "decontaminate", "mixing", "pairs", "conversations", "warc")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"quarry.llm.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
