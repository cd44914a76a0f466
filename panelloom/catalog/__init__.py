"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from . import backtests, binning, cleaning, hooks, interpreting, joins, learning, scans, searching, studies
from . import summaries, testing
from .base import Entry

MODULES = (
    scans, cleaning, joins, summaries, binning, backtests, learning, searching, testing,
    interpreting, studies, hooks,
)


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for module in MODULES:
        for name, entry in module.ENTRIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = entry
    return out
