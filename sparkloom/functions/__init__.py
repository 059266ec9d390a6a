"""functions of the SQL engine."""
