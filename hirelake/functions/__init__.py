"""Column expressions: one module per kind of scalar."""
