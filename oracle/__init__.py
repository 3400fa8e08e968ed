"""DuckDB twins of the registered queries, written by hand against the same tables."""
