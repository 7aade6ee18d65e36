"""Named queries over the given tables, each with its DuckDB oracle SQL."""
