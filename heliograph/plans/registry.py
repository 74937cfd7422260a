"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from heliograph.plans import aggregates, changes, joins, library, media, sequences, texts, vectors

FAMILIES = [sequences, aggregates, joins, changes, texts, vectors, media, library]
QUERIES = {name: f for m in FAMILIES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in FAMILIES for name, sql in m.ORACLES.items()}
