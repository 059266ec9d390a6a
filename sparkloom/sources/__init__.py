"""sources of the SQL engine."""
