"""The registered queries with their DuckDB equivalents, one module per operator family."""
