"""Every query of the library outside llm, with its SQL."""

from __future__ import annotations

from orrery.plans import catalogue, discovery, frontier, gates, ledger, observed, policies, structure, tables, verdicts, web

_ALL = [web.R, catalogue.R, discovery.R, frontier.R, gates.R, ledger.R, observed.R, policies.R, structure.R, tables.R, verdicts.R]
QUERIES = {name: f for r in _ALL for name, f in r.queries.items()}
ORACLE_SQL = {name: sql for r in _ALL for name, sql in r.sql.items()}
FLAGSHIP = "url_shortlist"
