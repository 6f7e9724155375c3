"""All queries of the core library."""

from __future__ import annotations

from .core_queries import CORE
from .q_match import MATCH
from .q_panel import PANEL
from .q_sampling import SAMPLING
from .q_stream import STREAM
from .q_text import TEXT
from .registry import Registry

_PARTS = [CORE, TEXT, MATCH, PANEL, SAMPLING, STREAM]


def catalog() -> Registry:
    out = Registry()
    for part in _PARTS:
        out.update(part)
    return out
