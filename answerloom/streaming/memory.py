"""Conversation memory: every message of every thread, and counters for each thread.

The messages themselves are rows of a table, in long form, so a thread of any length is kept
whole and is never one row. The state of the stream is two numbers for each thread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.streaming.ingest import append_files

COLUMNS = ("conv_id", "turn", "role", "text")


def remember(messages: DataFrame, path: str, checkpoint: str) -> None:
    """Append the messages of a stream that are new since the last run to the memory at ``path``."""
    append_files(messages.select(*COLUMNS), path, checkpoint)


def recall_threads(memory: DataFrame, conversations: DataFrame) -> DataFrame:
    """All remembered messages of some ``conversations``; ``turn`` gives their order."""
    return memory.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")


def conversation_state(messages: DataFrame) -> DataFrame:
    """``conv_id, n_messages, last_turn`` of a table, or of a stream in update mode.

    Both are partial aggregates: a task sends one row for each thread it saw, however hot.
    """
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("last_turn")
    )


def conversation_memory(messages: DataFrame) -> DataFrame:
    """Every message with the counters of its thread: ``COLUMNS``, ``n_messages``, ``last_turn``."""
    return messages.select(*COLUMNS).join(conversation_state(messages), "conv_id", "left")
