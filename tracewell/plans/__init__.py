"""Named queries of the library, and the SQL that gives the same rows."""

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in ("catalog_queries", "lineage_queries", "data_queries", "stream_queries", "summary_queries", "filter_queries", "sequence_queries", "registration_queries", "pipeline_queries", "read_queries", "account_queries"):
    _module = import_module(f"tracewell.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
