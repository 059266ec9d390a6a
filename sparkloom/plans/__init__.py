"""plans of the SQL engine."""
