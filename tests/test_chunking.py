from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from answerloom.functions.chunking import chunk_array, chunk_documents, split_text
from answerloom.sources import scan

texts = st.lists(
    st.tuples(st.integers(1, 12), st.sampled_from([". ", "! ", "?\n", " "])), max_size=30
).map(lambda parts: "".join(" ".join(f"w{i}" for i in range(n)) + end for n, end in parts))


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(2, 15), st.integers(0, 5))
def test_properties(text, size, overlap):
    overlap = min(overlap, size - 1)
    chunks = split_text(text, size, overlap)
    assert all(1 <= len(chunk.split()) <= size for chunk in chunks)
    # A chunk may begin up to ``overlap`` words before the end of the last one. Words repeat, so all
    # places where it could begin are followed.
    words, ends = text.split(), {0}
    for number, chunk in enumerate(chunks):
        own = chunk.split()
        starts = {end - n for end in ends for n in range(min(overlap, end) + 1 if number else 1)}
        ends = {start + len(own) for start in starts if words[start : start + len(own)] == own}
    assert len(words) in ends


def test_overlap_is_whole_sentences():
    text = "a b c. d e. f g h i. j k."
    assert split_text(text, 6, 2) == ["a b c. d e.", "d e. f g h i.", "j k."]
    assert split_text(text, 6, 0) == ["a b c. d e.", "f g h i. j k."]


def test_long_sentence_is_cut():
    assert split_text("a b c d e f g.", 3, 1) == ["a b c", "d e f", "g."]


def test_blank_texts_leave_no_row(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "x")], "id int, t string")
    assert [tuple(r) for r in chunk_documents(df, "t", ["id"]).collect()] == [(3, 0, "x")]


def test_arrow_batch_size_and_partitions_do_not_matter(spark, tiny):
    documents = scan(spark, tiny, "documents")

    def run(partitions):
        rows = chunk_documents(documents.repartition(partitions), "text", ["doc_id"], 50, 10)
        return sorted(map(tuple, rows.collect()))

    expected = run(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert run(5) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bad_sizes():
    import pytest

    with pytest.raises(ValueError):
        chunk_array("t", 5, 5)


def test_texts_of_a_batch_are_split_part_by_part(spark):
    texts = [None if i % 5 == 0 else " ".join(f"w{i}." for _ in range(i % 7)) for i in range(700)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r.id: r.c for r in frame.select("id", chunk_array("text", 4, 1).alias("c")).collect()}
    assert got == {i: split_text(t, 4, 1) for i, t in enumerate(texts)}
