"""Catalog modules in the order of the operator inventory."""

NAMES = (
    "sources",
    "bitemporal",
    "ingest",
    "audits",
    "statistics",
    "windows",
    "features",
    "metrics",
    "relations",
    "scoring",
)
