"""All registered queries; importing the catalogue modules fills the registry."""

from __future__ import annotations

import importlib

from .registry import HEADLINE, ORACLE, QUERIES

_MODULES = (
    "catalog_daily",
    "catalog_metrics",
    "catalog_state",
    "catalog_text",
    "catalog_topics",
    "catalog_forecast",
    "catalog_stream",
)

for _m in _MODULES:
    importlib.import_module(f"{__package__}.{_m}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v() if callable(v) else v for k, v in ORACLE.items()}


def headline():
    return list(HEADLINE)
