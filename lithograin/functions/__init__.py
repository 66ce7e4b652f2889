"""Expressions: predicates, patterns, aggregates, ordering."""
