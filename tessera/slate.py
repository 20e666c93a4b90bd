"""All queries of the library outside its training-data folder, by name, and their SQL for comparison."""

from __future__ import annotations

from .queries import contracts, documents, graphs, health, profiles, texts

MODULES = (profiles, texts, graphs, health, documents, contracts)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict = {k: s for m in MODULES for k, s in m.ORACLES.items()}
