"""Named queries over the test tables and the DuckDB SQL that states their results."""

from tamarack.plans import agent_queries, composed_queries, evaluation_queries, operations_queries, report_queries, retrieval_queries, shown_queries, store_queries, usage_queries

#: White space of any script, for trim in SQL.
BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

_MODULES = (retrieval_queries, evaluation_queries, operations_queries, agent_queries, composed_queries, store_queries, shown_queries, usage_queries, report_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql.replace("@BLANK@", BLANK) for module in _MODULES for name, sql in module.ORACLES.items()}
