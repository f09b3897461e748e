"""Every registered query of the radar engine, with its DuckDB equivalent."""

from __future__ import annotations

from squall.plans import q_feed, q_fields, q_wire

QUERIES = {**q_fields.QUERIES, **q_wire.QUERIES, **q_feed.QUERIES}
ORACLES = {**q_fields.ORACLES, **q_wire.ORACLES, **q_feed.ORACLES}
FLAGSHIP = "d01_moment_decode"
