"""The core's queries by name and their SQL."""

from __future__ import annotations

from .plans import feeds, ingest, records, search, units

QUERIES = search.QUERIES | units.QUERIES | records.QUERIES | feeds.QUERIES | ingest.QUERIES
ORACLE = search.ORACLE | units.ORACLE | records.ORACLE | feeds.ORACLE | ingest.ORACLE
