"""Logical types, vector arithmetic and predicates as expressions over Spark columns."""
