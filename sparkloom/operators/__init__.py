"""operators of the SQL engine."""
