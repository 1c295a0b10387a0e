"""Blocks: runs of neighbouring rows, small enough for one task, that have a dictionary of their own.

What a task finds in a block is written as small numbers of the block's dictionary. Only the
dictionary's distinct entries meet those of other blocks; what was learned about them goes back to
the block. A value that every row has is thus moved once for each block, and nothing that grows with
the corpus is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def cut_blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[int, pa.Table]]:
    """Number of a block, unique in the job, and its rows: up to ``limit`` bytes of text, one row at least.

    Rows keep their order. Inside a Spark task only, since the numbers begin with the task's own.
    """
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        bytes_of = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = 0
        for ix, n in enumerate(bytes_of):
            if size and size + n > limit:
                if ix > start:
                    held.append(batch.slice(start, ix - start))
                yield number, pa.Table.from_batches(held)
                number, held, size, start = number + 1, [], 0, ix
            size += n
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield number, pa.Table.from_batches(held)
