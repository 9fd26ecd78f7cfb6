"""All queries of the library, by name."""

from __future__ import annotations

from tessitura.plans import feature_queries, general, io_queries, matrix_queries, model_queries, signal_queries, trial_queries

MODULES = [general, trial_queries, feature_queries, matrix_queries, model_queries, signal_queries, io_queries]
FLAGSHIP = "eer_by_source"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
