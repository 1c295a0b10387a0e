"""Incremental jobs and state that outlives a batch."""

from answerloom.streaming.ingest import (
    append_available,
    append_files,
    run_chunk_job,
    run_ingest_job,
)
from answerloom.streaming.memory import (
    conversation_memory,
    conversation_state,
    recall_threads,
    remember,
)

__all__ = [
    "append_available",
    "append_files",
    "conversation_memory",
    "conversation_state",
    "recall_threads",
    "remember",
    "run_chunk_job",
    "run_ingest_job",
]
