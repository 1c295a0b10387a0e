"""Spark-first question answering over documents, tables and conversations."""

from answerloom.config import Settings
from answerloom.session import build_session

__all__ = ["Settings", "build_session"]
