from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.llm import _quotient as Q
from answerloom.llm import collocations as C


@pytest.mark.parametrize("n", [2, 3, 4, 5])
@pytest.mark.parametrize("width", [1, 3, 11, 12, 13, 16, 21, 22, 31, 32])
def test_permutation_and_packing_are_undone(n, width):
    draw = np.random.default_rng(n * 100 + width)
    grams = draw.integers(0, 1 << width, (500, n))
    columns = Q.permute(grams, width)
    assert all(int(c.max()) < 1 << width for c in columns)
    packing = Q.Packing(n, width)
    again = packing.unpack(packing.pack(columns))
    assert np.array_equal(Q.restore(again, width), grams)


def test_permutation_spreads_neighbouring_grams():
    grams = np.array([(a, b) for a in range(100) for b in range(100)])
    packing = Q.Packing(2, 14, 4)
    shards = packing.shards(packing.pack(Q.permute(grams, 14))[0])
    assert np.bincount(shards, minlength=16).max() < 2 * len(grams) / 16


@pytest.mark.parametrize("n, width, bits", [(2, 7, 0), (2, 32, 5), (3, 12, 3), (4, 22, 2), (5, 12, 6), (5, 20, 0), (5, 32, 4), (2, 2, 9)])
def test_filters_are_lossless_and_merge_like_counters(n, width, bits):
    draw = random.Random(n * width + bits)
    size = min(1 << width, 40)
    blocks = [Counter(tuple(draw.randrange(size) for _ in range(n)) for _ in range(draw.randrange(1, 700))) for _ in range(5)]
    packing = Q.Packing(n, width, bits)
    shards: dict[int, list[bytes]] = {}
    for block in blocks:
        grams, counts = np.array(list(block)), np.array(list(block.values()))
        limbs, counts = Q.ordered(packing.pack(Q.permute(grams, width)), counts)
        numbers = packing.shards(limbs[0])
        assert (np.diff(numbers) >= 0).all()
        for shard in np.unique(numbers).tolist():
            at = numbers == shard
            data = Q.write_filter(packing, shard, [limb[at] for limb in limbs], counts[at])
            again, numbers_again = Q.read_filter(packing, shard, data)
            assert all(np.array_equal(x, y[at]) for x, y in zip(again, limbs)) and np.array_equal(numbers_again, counts[at])
            shards.setdefault(shard, []).append(data)
    found = Counter()
    for shard, filters in shards.items():
        limbs, counts = Q.merge_filters(packing, shard, filters)
        for gram, count in zip(Q.restore(packing.unpack(limbs), width).tolist(), counts.tolist()):
            found[tuple(gram)] += count
    assert found == sum(blocks, Counter())


def test_filters_are_compact():
    grams = np.random.default_rng(5).integers(0, 1 << 12, (100_000, 3))
    limbs, counts = Q.ordered(Q.Packing(3, 12).pack(Q.permute(grams, 12)), np.ones(len(grams), np.int64))
    data = Q.write_filter(Q.Packing(3, 12), 0, limbs, counts)
    assert len(data) < 5 * len(counts)


def slow(rows, least, longest, best, share):
    """Everything by counters and loops."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    found = {}
    often = {key: a for key, a in counts.items() if a >= least and len(key[1]) >= 2}
    for (lang, words), a in often.items():
        inside = False
        for (other, around), b in often.items():
            if other == lang and len(around) > len(words) and 100 * b >= share * a:
                inside |= any(around[i : i + len(words)] == words for i in range(len(around)))
        if inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    for lang, phrases in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[:best], 1):
            yield lang, rank, phrase.decode(), -a, left, right, totals[lang], -score


@pytest.mark.parametrize("least, longest, best, share, block, shard", [(3, 5, 2000, 100, 900, 50), (2, 4, 7, 60, 1 << 20, 4_000_000)])
def test_equal_to_counters(spark, least, longest, best, share, block, shard):
    draw = random.Random(least)
    words = ["the", "The", "of", "a", "new", "York", "émile", "ＡＢ", "x y", "of"] + [f"w{i}" for i in range(12)]
    gaps = [" "] * 9 + ["\t", "  ", ", ", ".", "\n", "\x0b", "! ", ";"]
    rows = [(None, None), ("en", ""), ("en", "..."), (None, "new york new york new york"), ("zz", "one")]
    for _ in range(250):
        text = "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(25)))
        rows += [(draw.choice(["en", "en", "de", None, "und"]), text)] * draw.choice([1, 1, 3])
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found = C.mine(docs, least=least, longest=longest, best=best, share=share, block=block, shard=shard)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got, wanted = sorted(map(tuple, found.collect())), sorted(slow(rows, least, longest, best, share))
    assert len(wanted) > 20 and got == wanted


def test_frequent_words_are_joined_where_they_are_too_many_to_send(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sent = sorted(map(tuple, C.mine(docs, least=20).collect()))
    monkeypatch.setattr(C, "SENT_WORDS", 3)
    assert sorted(map(tuple, C.mine(docs, least=20).collect())) == sent and len(sent) > 50


def test_pairs_are_never_missed_and_few_pass():
    draw = np.random.default_rng(8)
    grams = draw.integers(0, 5000, (20_000, 2))
    bits = np.zeros(1 << (C.PAIR_BITS - 6), np.uint64)
    for place in C.PairFilter.places("en", grams[:10_000]):
        np.bitwise_or.at(bits, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    pairs = C.PairFilter(bits)
    assert pairs.holds("en", grams[:10_000]).all()
    assert pairs.holds("en", grams[10_000:]).mean() < 0.01 and pairs.holds("de", grams[:10_000]).mean() < 0.01


def test_longer_runs_need_allowed_pairs():
    ids = np.array([1, 2, 3, 4, -1, 2, 3, 4, 1, 2])
    every = {tuple(g): n for grams, counts in C.count_phrases(ids, 4) for g, n in zip(grams.tolist(), counts.tolist())}
    assert every[2, 3, 4] == 2 and every[1, 2] == 2 and every[1, 2, 3, 4] == 1 and (4, 2) not in every
    some = {tuple(g) for grams, _ in C.count_phrases(ids, 4, lambda grams: ~((grams == [3, 4]).all(axis=1))) for g in grams.tolist()}
    assert some == {(1, 2), (2, 3), (3, 4), (4, 1), (1, 2, 3), (4, 1, 2)}


def test_scores_beyond_64_bits(spark):
    rows = [(10**12, 10**15, 2 * 10**12, 3 * 10**12), (123456789012, 98765432109876, 234567890123, 345678901234), (1, 1, 1, 1)]
    found = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint").select(
        C.cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    )
    assert [r[0] for r in found.collect()] == [1000 * a * n // (left * right) for a, n, left, right in rows]


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.lang, r.text) for r in awkward.collect()]
    found = C.mine(awkward.withColumnRenamed("n_chars", "rank").withColumnRenamed("score", "ids"), least=2)
    assert sorted(map(tuple, found.collect())) == sorted(slow(rows, 2, 5, 2000, 100))
    assert C.mine(nothing).count() == 0
