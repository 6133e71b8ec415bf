"""Names of the catalog queries: what runs on Spark, and the SQL that DuckDB runs beside it."""

from __future__ import annotations

from lanework.plans import carried, catalog, jobs, records, searches, texts

FLAGSHIP = "select_best"
QUERIES: dict = catalog.QUERIES | jobs.QUERIES | texts.QUERIES | records.QUERIES | searches.QUERIES | carried.QUERIES
ORACLES: dict = catalog.ORACLES | jobs.ORACLES | texts.ORACLES | records.ORACLES | searches.ORACLES | carried.ORACLES
