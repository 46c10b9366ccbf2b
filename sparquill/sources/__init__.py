"""Readers for the engine's tables."""
from sparquill.sources.tables import kept, table

__all__ = ["kept", "table"]
