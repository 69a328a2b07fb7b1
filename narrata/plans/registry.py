"""All queries over the engine's operators, with their SQL twins."""

from __future__ import annotations

from narrata.plans import jobs, joins, library, player, retrieval, runs, texts, timelines

_MODULES = (retrieval, texts, joins, timelines, library, runs, player, jobs)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
