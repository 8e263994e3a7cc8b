"""All registered queries of the document engine, and their SQL."""

from __future__ import annotations

from foliomill.plans import enrichment, live, reading, shelf, state, structure, web

QUERIES = {**structure.QUERIES, **reading.QUERIES, **enrichment.QUERIES, **web.QUERIES, **state.QUERIES, **live.QUERIES, **shelf.QUERIES}
ORACLES = {**structure.ORACLES, **reading.ORACLES, **enrichment.ORACLES, **web.ORACLES, **state.ORACLES, **live.ORACLES, **shelf.ORACLES}
