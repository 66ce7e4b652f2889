"""Query builder and SQL text."""
