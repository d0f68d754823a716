"""Expressions and aggregates as Spark columns."""
