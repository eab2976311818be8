"""DuckDB statements that re-derive every query from the raw tables."""
