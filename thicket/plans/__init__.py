"""Named queries with their SQL counterparts, a module for each area."""

#: Modules of this package that have QUERIES and ORACLE.
MODULES = ("problems", "graph_queries", "text_queries", "more_queries", "wider_queries")
