"""All registered queries and oracles."""

from tradelake.suite import history_queries, payload_queries, table_queries, view_queries

_MODULES = (view_queries, payload_queries, table_queries, history_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: text for m in _MODULES for name, text in m.ORACLES.items()}
