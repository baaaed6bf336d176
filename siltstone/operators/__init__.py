"""Relational operators: access, retrieval, operations, analytics."""
