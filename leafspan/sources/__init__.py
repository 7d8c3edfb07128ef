"""Readers and writers."""

from leafspan.sources.tables import table

__all__ = ["table"]
