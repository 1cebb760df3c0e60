"""Scalar predicates and aggregate functions as Column expressions."""
