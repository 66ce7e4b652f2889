"""LIKE patterns without an escape character."""

from __future__ import annotations

from pyspark.sql import Column


def pattern_class(pattern: str) -> str:
    """exact, prefix, suffix, contains or complex."""
    core = pattern.strip("%")
    if "_" in pattern or "%" in core:
        return "complex"
    before, after = pattern.startswith("%"), pattern.endswith("%")
    if not core and pattern:
        return "contains"
    return {(False, False): "exact", (False, True): "prefix", (True, False): "suffix", (True, True): "contains"}[before, after]


def like(column: Column, pattern: str) -> Column:
    """A backslash is an ordinary character, so it's doubled for Spark. Catalyst turns
    simple patterns into =, StartsWith, EndsWith or Contains and pushes what it can."""
    return column.like(pattern.replace("\\", "\\\\"))
