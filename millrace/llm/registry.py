"""Every training-data query by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, licenses, mixing, pieces, pii, prints, quality, secrets, simhash, urls

_MODULES = (pii, chat, pieces, quality, secrets, mixing, licenses, prints, urls, simhash)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
