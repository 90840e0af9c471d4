"""Composed jobs, binding views over the shared tables, and the query registry with its SQL twins."""
