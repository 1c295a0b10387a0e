from __future__ import annotations

from pathlib import Path

import pytest

from answerloom import sources as IO
from answerloom.session import cut_lineage, ensure_checkpoint_dir
from answerloom.streaming import (
    append_available,
    conversation_memory,
    conversation_state,
    recall_threads,
    remember,
    run_chunk_job,
    run_ingest_job,
)

PAGE = "<html><body><h1>T{0}</h1><p>One sentence here. Another {0}.</p></body></html>"


@pytest.fixture
def names(spark, new_folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS stream_tests")
    spark.sql("USE stream_tests")
    suffix = Path(new_folder("t")).parent.name.replace("-", "_")
    yield f"raw_{suffix}", f"chunks_{suffix}"
    spark.sql("USE default")


def test_files_to_chunks_incrementally(spark, tmp_path, new_folder, names):
    raw, chunks = names
    folder = tmp_path / "files"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.html").write_text(PAGE.format("a"))
    (folder / "sub" / "b.html").write_text(PAGE.format("b"))
    (folder / "broken.pdf").write_bytes(b"%PDF \xff\xfe")
    checkpoints = new_folder("raw"), new_folder("chunks")

    def run():
        run_ingest_job(spark, str(folder), raw, checkpoints[0], max_files=1)
        run_chunk_job(spark, raw, chunks, checkpoints[1], size=6, overlap=2, reject_table=f"{raw}_rejects")

    batch_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    IO.ensure_chunk_table(spark, "stream_tests", chunks)
    IO.ensure_chunk_table(spark, "stream_tests", chunks)
    run()
    first = spark.table(chunks).collect()
    types = {Path(r.path).name: r.mime_type for r in spark.table(raw).collect()}
    assert types == {"a.html": "text/html", "b.html": "text/html", "broken.pdf": "application/pdf"}
    assert {Path(r.source).name for r in first} == {"a.html", "b.html"}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch_rows

    run()  # nothing is new
    assert sorted(map(tuple, spark.table(chunks).collect())) == sorted(map(tuple, first))

    (folder / "c.html").write_text(PAGE.format("c"))
    run()
    after = spark.table(chunks).collect()
    assert spark.table(raw).count() == 4
    rejects = spark.table(f"{raw}_rejects").collect()
    assert [(Path(r.source).name, r.mime_type, r.reason) for r in rejects] == [("broken.pdf", "application/pdf", "not UTF-8")]
    assert len({r.id for r in after}) == len(after) > len(first)
    added = [r for r in after if Path(r.source).name == "c.html"]
    assert [r.chunk_ix for r in sorted(added, key=lambda r: r.chunk_ix)] == list(range(len(added)))
    spark.sql(f"DROP TABLE {raw}")
    spark.sql(f"DROP TABLE {chunks}")
    spark.sql(f"DROP TABLE {raw}_rejects")


def test_batch_reader_sees_the_same_files(spark, tmp_path):
    (tmp_path / "x.html").write_text("x")
    (tmp_path / "y.txt").write_text("y")
    files = IO.read_files(spark, str(tmp_path), "*.html")
    assert [Path(r.path).name for r in files.collect()] == ["x.html"]
    assert files.schema.names == IO.BINARY_FILE_SCHEMA.names


def test_stream_state_equals_batch(spark, tiny, new_folder):
    messages = IO.scan(spark, tiny, "conversations")
    folder = new_folder("stream")
    for part in ("turn % 2 = 0", "turn % 2 = 1"):
        messages.where(part).repartition(3).write.mode("append").parquet(folder)
    stream = (
        spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    )
    seen: dict[int, tuple] = {}

    def take(batch, _):
        for row in batch.collect():
            seen[row.conv_id] = (row.n_messages, row.last_turn)

    query = (
        conversation_state(stream)
        .writeStream.outputMode("update")
        .option("checkpointLocation", new_folder("checkpoint"))
        .trigger(availableNow=True)
        .foreachBatch(take)
        .start()
    )
    query.awaitTermination()
    expected = {r.conv_id: (r.n_messages, r.last_turn) for r in conversation_state(messages).collect()}
    assert seen == expected


def test_memory_keeps_whole_threads(spark, new_folder):
    schema = "conv_id long, turn long, role string, text string"
    incoming, memory, checkpoint = new_folder("in"), new_folder("memory"), new_folder("checkpoint")
    for first in (0, 300):
        rows = [(c, t, "user", f"{c}-{t}") for c in (1, 2) for t in range(first, first + 300)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(incoming)
        for _ in range(2):
            remember(spark.readStream.schema(schema).parquet(incoming), memory, checkpoint)
    held = conversation_memory(spark.read.parquet(memory)).collect()
    assert len(held) == 1200 and {(r.n_messages, r.last_turn) for r in held} == {(600, 599)}
    asked = spark.createDataFrame([(2,), (2,), (9,)], "conv_id long")
    thread = recall_threads(spark.read.parquet(memory), asked).orderBy("turn").collect()
    assert [(r.conv_id, r.text) for r in thread] == [(2, f"2-{t}") for t in range(600)]


def test_table_stream_and_writes(spark, new_folder, names):
    raw, copy = names
    rows = IO.local_rows(spark, [(1, "a"), (2, "b")], "id int, t string")
    IO.overwrite_table(rows, raw)
    IO.append_rows(rows.select("t", "id"), raw)
    checkpoint = new_folder("c")
    append_available(IO.stream_table(spark, raw), copy, checkpoint)
    assert spark.table(copy).count() == 4
    IO.append_rows(rows, raw)
    append_available(IO.stream_table(spark, raw), copy, checkpoint)
    assert spark.table(copy).count() == 6
    IO.overwrite_table(rows, raw)
    assert spark.table(raw).count() == 2
    spark.sql(f"DROP TABLE {raw}")
    spark.sql(f"DROP TABLE {copy}")


def test_checkpoint_folder_of_the_session_is_used(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder.rstrip("/") in ensure_checkpoint_dir(spark)
    kept = cut_lineage(spark.range(3))
    assert kept.count() == 3
    assert all(folder.rstrip("/") in name for name in kept.inputFiles())


def test_tables_are_registered(spark, tiny):
    tables = IO.load_tables(spark, tiny, ["region", "nation"])
    assert spark.table("nation").count() == tables["nation"].count() == 25
