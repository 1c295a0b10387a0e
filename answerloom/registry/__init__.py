"""Every query that is checked against SQL, grouped by area."""

from answerloom.registry import answers, guards, messages, search, tables, text
from answerloom.registry._base import REGISTRY, Entry

__all__ = ["REGISTRY", "Entry", "answers", "guards", "messages", "search", "tables", "text"]
