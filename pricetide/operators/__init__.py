"""Table-in, table-out job steps."""
