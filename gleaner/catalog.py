"""Registry of the engine's queries and of their DuckDB twins."""

from __future__ import annotations

from gleaner.queries import core, directory_pages, fixtures, flows, planned, stored

QUERIES: dict = core.QUERIES | planned.QUERIES | fixtures.QUERIES | directory_pages.QUERIES | flows.QUERIES | stored.QUERIES
ORACLES: dict = core.ORACLES | planned.ORACLES | fixtures.ORACLES | directory_pages.ORACLES | flows.ORACLES | stored.ORACLES
