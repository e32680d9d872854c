"""Operators for preparing training text: one module per operator, `queries` binds them to the given tables."""
