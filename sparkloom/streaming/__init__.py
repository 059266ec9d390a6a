"""streaming of the SQL engine."""
