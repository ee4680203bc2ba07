"""All queries of the engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import account_queries, case_queries, control_queries, feature_queries, hazard_queries, hypothesis_queries, intake_queries, interval_queries, lifecycle_queries, model_queries, source_queries, stream_queries, tick_queries

_MODULES = (lifecycle_queries, interval_queries, tick_queries, hazard_queries, control_queries, source_queries, case_queries, account_queries, feature_queries, model_queries, intake_queries, stream_queries, hypothesis_queries)

QUERIES = {name: f for module in _MODULES for name, f in module.Q.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
