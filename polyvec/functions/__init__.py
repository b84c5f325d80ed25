"""Scalar functions, predicates and patterns as Spark columns."""
