from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from answerloom.llm import simhash_dedup as S
from answerloom.llm._components import components


def slow_fingerprint(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def slow_classes(fps, ids, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, key in enumerate(ids):
        least[root(i)] = min(least.get(root(i), key), key)
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprint_by_brute_force():
    draw = random.Random(3)
    for n in [0, 1, 3, 4, 5, 80]:
        text = " \n".join(draw.choice(["Ab", "ÄB", "c", "dd", "E"]) for _ in range(n))
        assert S.fingerprint(text) == slow_fingerprint(text)
    assert S.fingerprint(None) == 0


def test_documents_by_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    expected = slow_classes(fps, [r.doc_id for r in rows], 4)
    for row, fp, least in zip(rows, fps, expected, strict=True):
        assert (got[row.doc_id].fingerprint, got[row.doc_id].component_id) == (f"{fp:016x}", least)


def test_links_across_small_tiles(spark):
    """Tiles of a few fingerprints, of which some are split by quarters and by hash."""
    draw = random.Random(5)
    fps = {draw.getrandbits(64) for _ in range(150)}
    for base in list(fps)[:40]:
        fps |= {base ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(8)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp bigint, doc_id bigint")
    got = {r.fp: r.component_id for r in S.classes(frame, tile=2).collect()}
    assert [got[f] for f in signed] == slow_classes(fps, list(range(len(fps))), 4)


def test_forest_is_small_and_connects():
    left = np.array([7] * 1 + [7 ^ (1 << i) for i in range(40)], np.uint64)
    edges = S.forest(left, None, 2)
    assert len(edges) == 40
    assert S.forest(left[:1], left[1:], 0) == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (3000, 2999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(61)} == {0}
    assert {got[1000 + i] for i in range(200)} == {1000}
    assert got[3000] == 2999 and 5 in got


def test_awkward_rows(spark, awkward, nothing):
    rows = S.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    zero = {r.doc_id: r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {3: 3, 4: 3, 5: 3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    kept = S.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "None"]
    assert S.near_duplicates(nothing).collect() == [] and S.keep_one_of_each(nothing).collect() == []
