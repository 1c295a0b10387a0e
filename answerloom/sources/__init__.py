"""Where rows come from and where they go."""

from answerloom.sources.files import BINARY_FILE_SCHEMA, read_files, read_files_stream
from answerloom.sources.tables import (
    append_rows,
    ensure_chunk_table,
    load_tables,
    local_rows,
    overwrite_table,
    scan,
    stream_scan,
    stream_table,
    with_chunk_id,
)

__all__ = [
    "BINARY_FILE_SCHEMA",
    "append_rows",
    "ensure_chunk_table",
    "load_tables",
    "local_rows",
    "overwrite_table",
    "read_files",
    "read_files_stream",
    "scan",
    "stream_scan",
    "stream_table",
    "with_chunk_id",
]
