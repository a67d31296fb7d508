"""Structured Streaming for tables that grow by files."""

from .tail import appended, append_to

__all__ = ["append_to", "appended"]
