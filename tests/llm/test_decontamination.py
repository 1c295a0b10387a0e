from __future__ import annotations

import random

import numpy as np

from answerloom.llm import decontamination as D

DRAW = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(3000)]


def prose(n):
    return [DRAW.choice(VOCABULARY) for _ in range(n)]


def slow(docs, items):
    """The best similarity of any window of the item's size, by trying all of them."""
    found = {}
    for doc, text in docs:
        words = D.words_of(text)
        for item, wanted in items:
            target = D.words_of(wanted)
            if not target or len(words) < len(target):
                continue
            best = max(
                D.similarity_of(" ".join(words[i : i + len(target)]), " ".join(target))
                for i in range(len(words) - len(target) + 1)
            )
            if best >= 0.8:
                found[doc, item] = best
    return found


def test_by_brute_force(spark):
    items = [(i, " ".join(prose(n))) for i, n in enumerate([12, 30, 30, 45, 60, 3, 1])]
    docs = [(100 + i, " ".join(prose(80))) for i in range(6)]
    for item, text in items:
        words = text.split()
        docs.append((200 + item, " ".join(prose(40) + words + prose(40))))
        if len(words) >= 45:
            edited = [*words[:-2], *prose(2)]
            docs.append((300 + item, " ".join(prose(5) + edited)))
            half = words[: len(words) // 2]
            docs.append((400 + item, " ".join(half + prose(40))))
    expected = slow(docs, items)
    got = D.find_passages(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
        ["doc_id"],
    ).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in expected.items()}
    assert {k[0] for k in expected} >= {203, 204, 303, 304}


def test_no_pair_within_the_radius_is_missed(spark):
    draw = random.Random(2)
    items = [(i, draw.getrandbits(63)) for i in range(30)]
    windows = []
    for i, fp in items:
        for k, flips in enumerate([0, 3, 15, 16, 20]):
            changed = fp
            for bit in draw.sample(range(63), flips):
                changed ^= 1 << bit
            windows.append((i * 10 + k, changed))
    left = spark.createDataFrame([(w, f, 10) for w, f in windows], "window bigint, fp bigint, n_words int")
    right = spark.createDataFrame([(i, f, 10) for i, f in items], "item_id bigint, fp bigint, n_words int")
    got = [(r.window, r.item_id, r.bits) for r in D.hamming_pairs(left, right).collect()]
    expected = [(w, i, bin(a ^ b).count("1")) for w, a in windows for i, b in items if bin(a ^ b).count("1") <= 15]
    assert sorted(got) == sorted(expected)


def test_few_pairs_are_candidates(spark):
    """Random fingerprints of one size: about one pair in twenty meets, where one value of sixteen would let all meet."""
    draw = random.Random(3)
    left = spark.createDataFrame([(w, draw.getrandbits(64) - (1 << 63), 10) for w in range(1500)], "window bigint, fp bigint, n_words int")
    right = spark.createDataFrame([(i, draw.getrandbits(64) - (1 << 63), 10) for i in range(400)], "item_id bigint, fp bigint, n_words int")
    assert D.hamming_candidates(left, right).count() <= 0.05 * 1500 * 400


def test_recall_by_band_of_similarity():
    """Texts as similar as the threshold mostly lie within the radius, more similar ones nearly always."""
    draw, memo = random.Random(6), D._Hashes()
    print_of = lambda words: D._simhashes(D._shingle_hashes(D._hashed(words, memo), 5), np.array([0]), len(words) - 4)[0]
    near = {0.80: [], 0.85: [], 0.9: []}
    while min(map(len, near.values())) < 250:
        words = [draw.choice(VOCABULARY) for _ in range(draw.randrange(40, 200))]
        edited = list(words)
        for _ in range(draw.randrange(1, 5)):
            edited[draw.randrange(len(edited))] = "new"
        similar = D.similarity_of(" ".join(words), " ".join(edited))
        band = max((b for b in near if similar >= b), default=None)
        if band is not None:
            apart = np.int64(print_of(words)) ^ np.int64(print_of(edited))
            near[band].append(int(apart & np.int64(2**63 - 1)).bit_count() + int(apart < 0) <= D.RADIUS)
    assert np.mean(near[0.80]) > 0.95 and np.mean(near[0.85]) > 0.98 and np.mean(near[0.9]) > 0.99


def test_filter_misses_no_shingle(spark):
    items = spark.createDataFrame([(list(map(int, np.arange(500) * 7919**4)),)], "shingles array<bigint>")
    hashes = np.array(items.first().shingles, np.int64).view(np.uint64)
    assert D._known(D._filter(items), hashes).all()


def test_awkward_rows(spark, awkward, nothing):
    text = awkward.where("doc_id = 1").first().text
    bench = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text)], "item_id bigint, text string")
    found = D.find_passages(awkward, bench, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (1, 4), (2, 1), (2, 4)]
    kept = D.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 3
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert D.drop_contaminated(awkward, empty).count() == awkward.count()
    assert D.find_passages(nothing, bench, ["doc_id"]).collect() == []


def test_items_longer_than_the_document_by_brute_force(spark):
    """Documents that are an item less some words, at either end or within, are compared as a whole."""
    draw = random.Random(5)
    made = lambda n: [draw.choice(VOCABULARY) for _ in range(n)]
    items = [(i, " ".join(made(n))) for i, n in enumerate([40, 41, 60, 37, 7, 6, 3, 200])]
    docs = []
    for item, text in items:
        words = text.split()
        for k, cut in enumerate([1, 3, len(words) // 15, len(words) // 2]):
            docs.append((100 * item + 10 * k, " ".join(words[: len(words) - cut])))
            docs.append((100 * item + 10 * k + 1, " ".join(words[cut:])))
            docs.append((100 * item + 10 * k + 2, " ".join(made(1) + words[cut:-1])))
    items.append((90, " ".join(docs[0][1].split() + made(2))))

    expected = {}
    for doc, text in docs:
        words = D.words_of(text)
        for item, wanted in items:
            size = min(len(words), len(D.words_of(wanted)))
            best = max((D.similarity_of(" ".join(words[i : i + size]), wanted) for i in range(len(words) - size + 1) if size), default=0)
            if best >= 0.8:
                expected[doc, item] = best
    got = D.find_passages(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
        ["doc_id"],
    ).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in expected.items()}
    assert {(10, 0), (11, 0), (210, 2), (710, 7)} <= expected.keys()


def test_items_without_an_id_contaminate(spark):
    words = [f"x{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:37])), (3, "something else altogether, and not short")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, " ".join(words))], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.find_passages(docs, bench, ["doc_id"]).collect()) == [(1, None), (2, None)]
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).collect()] == [3]
