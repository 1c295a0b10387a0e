from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from answerloom.llm import winnowing as W


def slow_selection(hashes, window=8):
    """Positions of the least hash of each window, the rightmost of equal ones."""
    found = []
    for at in range(max(1, len(hashes) - window + 1)):
        part = hashes[at : at + window]
        place = at + max(i for i, h in enumerate(part) if h == min(part))
        if place not in found:
            found.append(place)
    return found


def test_selection_by_brute_force(spark):
    draw = random.Random(9)
    texts = [" ".join(draw.choice("ab") for _ in range(n)) for n in (0, 1, 2, 3, 7, 10, 11, 40, 90)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in docs.select("text", W._grams(F.col("text"), 3).alias("g"), W.winnow(F.col("text")).alias("w")).collect():
        hashes = [g >> W.PLACE_BITS for g in row.g]
        assert [W.PLACES - (w & W.PLACES) for w in row.w] == slow_selection(hashes)


def test_shared_stretch_shares_a_hash(spark):
    draw = random.Random(1)
    shared = [f"s{draw.random()}" for _ in range(W.GRAM + W.WINDOW - 1)]
    texts = [" ".join([f"w{draw.random()}" for _ in range(n)] + shared + [f"w{draw.random()}" for _ in range(20)]) for n in (0, 13, 30)]
    sets = [set(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(W.hashes_of(W.winnow(F.col("t")))).collect()]
    assert sets[0] & sets[1] and sets[1] & sets[2]


def test_scripts_without_blanks_share_stretches(spark):
    draw = random.Random(2)
    made = lambda n: "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(n))
    shared = made(W.GRAM + W.WINDOW - 1)
    texts = [made(7) + shared + made(30), "a1 " + made(20) + shared + "b2", made(40), "漢ab字 cd", "漢 ab 字 cd"]
    sets = [set(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(W.hashes_of(W.winnow(F.col("t")))).collect()]
    assert sets[0] & sets[1] and not sets[0] & sets[2] and sets[3] == sets[4]


def test_edited_texts(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in W.compare_edited(docs).collect()}
    for ix, row in enumerate(rows):
        after, n = rows[(ix + 1) % len(rows)].text, len(row.text)
        edited = row.text[: n - n // 2] + after[: n // 2]
        found = got[row.doc_id]
        assert (found.n_chars, found.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= found.near_edited <= 1 and 0 <= found.near_next <= 1


def test_awkward_rows(spark, awkward, nothing):
    rows = W.compare_edited(awkward).collect()
    assert len(rows) == awkward.count()
    by = {}
    for row in rows:
        by.setdefault(row.doc_id, []).append(row)
    assert by[1][0].fingerprint == by[2][0].fingerprint == by[2][1].fingerprint
    assert 1.0 in {r.near_next for r in by[2]} and by[1][0].near_next == 1.0
    assert by[3][0].n_chars == 0 and by[3][0].near_next == 1.0
    assert W.compare_edited(nothing).collect() == []
    lone = W.compare_edited(awkward.where("doc_id = 1")).collect()
    assert lone[0].near_next == 1.0
