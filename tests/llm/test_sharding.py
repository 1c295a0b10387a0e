from __future__ import annotations

from collections import Counter, defaultdict

from answerloom.llm import sharding as S


def laws(rows, shards=16):
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(shards))
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))


def test_counts_slots_and_groups(spark):
    """A group with a third of all rows, pairs, and single rows."""
    rows = [(i, "same text") for i in range(160)] + [(1000 + i, f"pair {i // 2}") for i in range(80)]
    rows += [(2000 + i, f"alone {i}") for i in range(240)]
    found = S.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    laws(found)
    groups = defaultdict(set)
    for row in found:
        if row.doc_id < 2000:
            groups[row.text_crc32].add(row.shard)
    pairs = [s for c, s in groups.items() if c != next(r.text_crc32 for r in found if r.doc_id == 0)]
    assert sum(len(s) == 1 for s in pairs) >= 36


def cut_edges(rows):
    """Pairs of equal texts in different shards, counted one by one."""
    groups = defaultdict(list)
    for row in rows:
        groups[row.text_crc32].append(row.shard)
    return {c: sum(a != b for i, a in enumerate(g) for b in g[i + 1 :]) for c, g in groups.items()}


def test_a_third_of_all_rows_lies_in_the_fewest_shards(spark):
    """As in no smaller number it could; every pair is whole, and hardly an edge more is cut than must be."""
    rows = [(i, "same text") for i in range(1600)] + [(10_000 + i, f"pair {i // 2}") for i in range(800)]
    rows += [(20_000 + i, f"alone {i}") for i in range(2400)]
    found = S.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    laws(found)
    large = Counter(r.shard for r in found if r.doc_id < 10_000)
    assert len(large) == 6 == -(-1600 // 300)
    code = next(r.text_crc32 for r in found if r.doc_id == 0)
    cut = cut_edges(found)
    assert sum(n for c, n in cut.items() if c != code) == 0
    full = [300] * 5 + [100]
    assert cut[code] <= 1.1 * sum(a * b for i, a in enumerate(full) for b in full[i + 1 :])


def test_links_that_overlap_and_fill_everything(spark):
    """Rows of several links, and no row without one: quotas hold all the same."""
    groups = [(i, f"g{i // 9}") for i in range(900)]
    found = S.shard_documents(spark.createDataFrame(groups, "doc_id bigint, text string")).collect()
    laws(found)
    assert sum(n > 0 for n in cut_edges(found).values()) <= 16
    chain = spark.createDataFrame([(i, link) for i in range(300) for link in (i // 3, 1000 + (i + 1) // 3)], "row bigint, link bigint")
    placed = {r.row: r.shard for r in S.propagate(chain, 300, 4).collect()}
    assert len(placed) == 300 and set(placed.values()) <= set(range(4))
    assert sum(placed[i] != placed[i + 1] for i in range(299)) < 220


def test_packing():
    rooms = dict.fromkeys(range(4), 10)
    made = S.pack([(1, 25), (2, 7), (3, 3), (4, 5)], rooms)
    assert sum(n for link, _, n in made if link == 1) == 25 and len([m for m in made if m[0] == 1]) == 3
    assert all(room >= 0 for room in rooms.values()) and {m[0]: 1 for m in made if m[0] != 1} == {2: 1, 3: 1, 4: 1}


def test_awkward_rows(spark, awkward, nothing):
    found = S.shard_documents(awkward).collect()
    laws(found)
    sizes = {r.doc_id: r["size"] for r in found}
    assert sizes[3] == 1 and sizes[4] == 1 and sizes[7] == 200_001
    assert len(found) == awkward.count() and all(r.grown_shard is None and r.law == "rows" for r in found)
    assert S.shard_documents(nothing).collect() == []
