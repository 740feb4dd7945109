"""Registered queries over the driver's tables, each with its SQL for the oracle."""

from . import building, comparing, dashboards, estate, listings, mastering, operations, recon, records, scans, stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (recon, records, mastering, estate, operations, listings, dashboards, comparing, building, scans, stored):
    QUERIES |= {name: query for name, (query, _) in _part.PLANS.items()}
    ORACLE_SQL |= {name: sql for name, (_, sql) in _part.PLANS.items() if sql}
