"""The registered queries and their reference SQL, by family."""

from __future__ import annotations

import importlib

FAMILIES = [
    "projections",
    "scorecard",
    "health",
    "timeseries",
    "advise",
    "trace",
    "sources",
    "stream",
]


def collect(kind: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        module = importlib.import_module(f"tidemark.catalog.{family}")
        entries = getattr(module, kind)
        clash = out.keys() & entries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(entries)
    return out
