"""All registered queries and their SQL."""

from driftline.plans import cell_queries, row_queries

QUERIES: dict = cell_queries.Q | row_queries.Q
ORACLES: dict = cell_queries.SQL | row_queries.SQL
