"""Column expressions without any table-wide statistics."""
