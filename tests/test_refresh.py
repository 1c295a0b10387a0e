from __future__ import annotations

import numpy as np

from answerloom.config import Settings
from answerloom.functions.embedding import hashed_words
from answerloom.operators.search import train_centroids
from answerloom.plans.refresh import evaluate_retrieval, refresh_chunks, refresh_index, write_eval_set

PAGE = "<html><body><p>{0} keys are added in {0}. Then more {0} follows here.</p></body></html>"


def test_files_to_score(spark, tmp_path, new_folder):
    settings = Settings(
        database="refresh_tests", chunk_size=8, chunk_overlap=0, eval_questions=4, embedding_dim=64
    )
    files = tmp_path / "files"
    files.mkdir()
    for word in ("alpha", "beta", "gamma"):
        (files / f"{word}.html").write_text(PAGE.format(word))
    embedded = spark.sparkContext.accumulator(0)

    def model():
        encode = hashed_words(64)()

        def counted(texts):
            embedded.add(len(texts))
            return np.asarray(encode(texts))

        return counted

    try:
        checkpoints = new_folder("checkpoints")
        chunks = refresh_chunks(spark, settings, str(files), checkpoints)
        first_path = new_folder("index")
        first = refresh_index(chunks, settings, first_path, model=model)
        assert first.count() == chunks.count() == embedded.value == 6

        (files / "delta.html").write_text(PAGE.format("delta"))
        chunks = refresh_chunks(spark, settings, str(files), checkpoints)
        centroids = train_centroids(first, 2)
        index = refresh_index(
            chunks, settings, new_folder("index"), first_path, centroids=centroids, model=model
        )
        assert index.count() == 8 and embedded.value == 8
        assert "cell" in index.columns

        evals = write_eval_set(chunks, settings)
        assert evals.count() == 4
        exact = evaluate_retrieval(evals, index, settings, model=model).first()
        assert (exact.n_questions, exact.hit_rate, exact.ungrounded_share) == (4, 1.0, 0.0)
        assert exact.mrr > 0.9
        near = evaluate_retrieval(evals, index, settings, centroids=centroids, model=model).first()
        assert near.hit_rate == 1.0
    finally:
        spark.sql("USE default")
        spark.sql("DROP DATABASE IF EXISTS refresh_tests CASCADE")
