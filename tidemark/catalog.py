"""Registered queries of the time-series operators, with their oracle SQL."""

from __future__ import annotations

from tidemark.plans import chains, decoding, dynamics, extra, models, more, preprocess, tasks

FLAGSHIP = "agg01_fractional_occupancy"
_MODULES = (dynamics, preprocess, models, tasks, more, extra, decoding, chains)
QUERIES: dict = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES: dict = {name: q for m in _MODULES for name, q in m.ORACLES.items()}
