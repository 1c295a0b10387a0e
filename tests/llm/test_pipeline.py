from __future__ import annotations

from collections import Counter

import corpus_pipeline
from answerloom.llm import decontamination, simhash_dedup
from answerloom.session import cut_lineage


def test_stages_one_after_another(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut_lineage(stage(spark, before, tiny))
        assert after.columns == docs.columns, name
        kept, there = Counter(r.doc_id for r in after.collect()), {r.doc_id for r in before.collect()}
        assert set(kept) <= there
        if name != "mixing":
            assert max(kept.values()) == 1
        if name == "simhash_dedup":
            classes = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(before).collect()}
            assert set(kept) == set(classes.values())
        if name == "decontamination":
            bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
            bad = {r.doc_id for r in decontamination.find_passages(before, bench, ["doc_id"]).collect()}
            assert bad and set(kept) == there - bad
        before = after
    placed = corpus_pipeline.STAGES[-1][1](spark, before, tiny).collect()
    sizes = Counter(r.shard for r in placed)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert len(placed) == before.count() == len(corpus_pipeline.run(spark, tiny).collect())


def test_awkward_rows(spark, awkward, nothing, tiny):
    for start in (awkward, nothing):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut_lineage(stage(spark, docs, tiny))
            assert docs.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, tiny).count() == docs.count()
