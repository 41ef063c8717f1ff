"""Span-level entity detection for Traditional Chinese text, and its benchmark, as Spark DataFrame plans."""
