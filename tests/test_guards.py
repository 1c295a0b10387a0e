from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.functions.pii import DEFAULT_ENTITIES, detect_pii, pii_verdict
from answerloom.operators import grounding as H
from answerloom.operators import guards as G

SAMPLES = {
    "PERSON": "ask Maria Lopez or Dr. Smith today",
    "CREDIT_CARD": "card 4111 1111 1111 1111 now",
    "PHONE_NUMBER": "call (212) 555-0123 now",
    "IP_ADDRESS": "host 10.0.0.12 down",
    "US_SSN": "ssn 123-45-6789 here",
    "US_PASSPORT": "passport C12345678 here",
    "US_BANK_NUMBER": "account number: 123456789012 here",
    "US_ITIN": "itin 912-70-1234 here",
    "US_DRIVER_LICENSE": "driver's license D1234567 here",
    "EMAIL_ADDRESS": "write jo.do+x@mail.example.org now",
    "CRYPTO": "send to 1BoatSLRHtKNngkdXEeobR76b53LETtpyT now",
}


def test_every_entity_is_found(spark):
    df = spark.createDataFrame(list(SAMPLES.items()), "name string, t string")
    found = {(r.name, r.entity) for r in detect_pii(df, "t", ["name"]).collect()}
    assert {(name, name) for name in DEFAULT_ENTITIES} <= found
    clean = spark.createDataFrame([("nothing 12 here", 1), (None, 2)], "t string, i int")
    assert detect_pii(clean, "t", ["i"]).collect() == []


def test_hits_and_order(spark):
    text = "a@b.io 10.0.0.1 c@d.io account 12345678"
    df = spark.createDataFrame([(text,)], "t string")
    assert [tuple(r) for r in detect_pii(df, "t", []).collect()] == [
        ("IP_ADDRESS", 0, "10.0.0.1"),
        ("US_BANK_NUMBER", 0, "12345678"),
        ("EMAIL_ADDRESS", 0, "a@b.io"),
        ("EMAIL_ADDRESS", 1, "c@d.io"),
    ]
    verdict = df.select(pii_verdict("t", ["EMAIL_ADDRESS"]).alias("v")).select("v.*").first()
    assert tuple(verdict) == (
        False, "PII detected: EMAIL_ADDRESS, EMAIL_ADDRESS", ["EMAIL_ADDRESS"] * 2
    )
    passed = spark.createDataFrame([("x",)], "t string").select(pii_verdict("t")).first()[0]
    assert tuple(passed) == (True, "No PII detected", [])
    with pytest.raises(ValueError):
        pii_verdict("t", ["SHOE_SIZE"])


def test_topics_are_strict_and_sorted(spark):
    lexicon = {"a": ["x"], "b": ["x", "y"], "c": ["1", "2", "3", "4", "5"]}
    df = spark.createDataFrame([("X 1 2 3 4",), ("x y 1 2 3 4 5",), ("",)], "t string")
    got = [r[0] for r in df.select(G.detect_topics("t", lexicon)).collect()]
    assert got == [["a"], ["a", "b", "c"], []]  # 4 of 5 is 0.8, which is not above 0.8
    message = df.select(G.topic_verdict("t", lexicon)["message"]).collect()
    assert message[0][0] == "The text contains the following banned topics: ['a']"
    assert message[2][0] is None
    for empty in ({}, {"politics": []}):
        with pytest.raises(ValueError):
            G.topic_scores("t", empty)


def test_guard_message_carries_the_name(spark):
    messages = spark.createDataFrame(
        [(1, 0, "user", "q", None), (1, 4, "assistant", "a", "documents"), (2, 0, "user", "q", None)],
        "conv_id long, turn long, role string, text string, name string",
    )
    verdicts = spark.createDataFrame(
        [(1, "g2", False, "second"), (1, "g1", False, "first"), (1, "g0", True, None), (2, "g1", True, None)],
        "conv_id long, guard string, passed boolean, message string",
    )
    got = G.apply_guards(messages, verdicts).orderBy("conv_id", "turn").collect()
    assert len(got) == 4
    assert tuple(got[2]) == (1, 5, "assistant", "Guard failed - first; second", "documents")


# ---- grounding -------------------------------------------------------------


def grams(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def borne_out(sentence, sources, n, threshold):
    words = sentence.lower().split()
    if not words:
        return False
    wanted = grams(words, min(n, len(words)))
    return any(
        len(wanted & grams(s.lower().split(), min(n, len(words)))) >= threshold * len(wanted) - 1e-9
        for s in sources
    )


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
@pytest.mark.parametrize("pooled", [False, True])
def test_grounding_equals_brute_force(spark, threshold, pooled):
    rng = random.Random(3)

    def text(n):
        return " ".join(rng.choice("abcd") for _ in range(n))

    sources = [(i % 3, text(rng.randint(0, 25))) for i in range(20)]
    sources += [(0, sources[0][1])] * 10  # a third are copies of one text
    asked = [(i % 4, i, text(rng.randint(0, 9))) for i in range(60)]
    asked += [(s, 100 + i, " ".join(t.split()[2:8])) for i, (s, t) in enumerate(sources[:20])]
    s = spark.createDataFrame(sources, "p int, text string")
    a = spark.createDataFrame(asked, "p int, i int, sentence string")
    got = H.grounded_sentences(a, s, pool="p" if pooled else None, threshold=threshold)
    expected = {
        i: borne_out(t, [x for p, x in sources if not pooled or p == pool], 3, threshold)
        for pool, i, t in asked
    }
    assert {r.i: r.grounded for r in got.collect()} == expected


def test_without_sources_nothing_is_grounded(spark):
    a = spark.createDataFrame([(1, "a b c d"), (1, "")], "i int, sentence string")
    s = spark.createDataFrame([], "text string")
    assert [r.grounded for r in H.grounded_sentences(a, s).collect()] == [False, False]


def test_check_answers_pools_sources_per_answer(spark):
    sources = spark.createDataFrame(
        [(1, "the cat sat on the mat"), (2, "dogs bark loudly at night")], "id int, content string"
    )
    answers = spark.createDataFrame(
        [(1, "The cat sat on the mat. Dogs bark loudly at night."), (2, "Cows fly over houses."), (3, "")],
        "answer_id int, text string",
    )
    checked = H.check_answers(answers, sources, min_score=0.5)
    got = {(r.answer_id, r.sentence_ix): r.grounded for r in checked.collect()}
    # The final full stop is part of the last word, so one gram of four differs.
    assert got == {(1, 0): False, (1, 1): False, (2, 0): False}
    easier = H.check_answers(answers, sources, min_score=0.5, threshold=0.6)
    assert {(r.answer_id, r.sentence_ix) for r in easier.collect() if r.grounded} == {(1, 0), (1, 1)}
    verdicts = {r.answer_id: r for r in G.grounding_verdicts(easier, "answer_id").collect()}
    assert verdicts[1].passed and verdicts[1].message is None
    assert verdicts[2].message == "The following sentences are hallucinated: ['Cows fly over houses.']"


def test_bad_threshold(spark):
    df = spark.range(1).select(F.lit("a").alias("sentence"), F.lit("a").alias("text"))
    with pytest.raises(ValueError):
        H.grounded_sentences(df, df, threshold=0)


def test_long_runs_of_words_and_of_characters(spark):
    """Neither the number of words in a run nor the length of a run of characters may hurt."""
    from answerloom.functions.pii import pii_hits

    texts = ["Aa Bb " * 50_000, "x" * 1_000_000 + "@", "Mr Smith " + "Ab " * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    hits = [r[0] for r in df.select(pii_hits("text", ["PERSON", "EMAIL_ADDRESS"])).collect()]
    assert hits[:2] == [[], []] and [h.entity for h in hits[2]] == ["PERSON"]


def test_a_sentence_of_very_many_sources(spark, monkeypatch):
    """Postings of a hot gram are cut into slots; near copies settle nothing, the one source that covers does."""
    from answerloom.operators import grounding as G

    words = [f"w{i}" for i in range(12)]
    near = [" ".join([*words[:5], f"x{i}", *words[5:7]]) for i in range(600)]
    whole = " ".join(words)
    asked = spark.createDataFrame([(1, whole), (2, " ".join([*words[:6], *reversed(words[6:])])), (3, "w0 w1 w2 w3 w4")], "k int, sentence string")
    sources = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    for texts, grounded in ((near, {3}), ([*near, f"so {whole} it is"], {1, 3})):
        plain = {r.k for r in G.grounded_sentences(asked, sources(texts)).where("grounded").collect()}
        monkeypatch.setattr(G, "SLOT", 40)
        cut = {r.k for r in G.grounded_sentences(asked, sources(texts)).where("grounded").collect()}
        monkeypatch.undo()
        assert plain == cut == grounded
    held = spark.range(1000).selectExpr("0 AS pool", "1L AS gram", "cast(id AS string) AS source")
    sizes = G.slotted(held, spark.createDataFrame([(0, 1, 25)], "pool int, gram bigint, slots bigint")).groupBy("slot").count().collect()
    assert len(sizes) == 25 and max(r["count"] for r in sizes) < 2 * 1000 / 25


def test_models_for_topics_and_entailment(spark):
    from answerloom.operators import grounding as G
    from answerloom.operators import guards as T

    def topics():
        return lambda texts, names: [[0.9 if name in text else 0.8 for name in names] for text in texts]

    df = spark.createDataFrame([(1, "on politics and sports"), (2, "nothing"), (3, None), (4, "sports")], "k int, text string")
    verdicts = {r.k: r.v for r in df.select("k", T.topic_verdict("text", ["politics", "sports"], model=topics).alias("v")).collect()}
    assert verdicts[1].detail == ["politics", "sports"] and not verdicts[1].passed and verdicts[2].passed
    assert verdicts[4].message == "The text contains the following banned topics: ['sports']"
    with pytest.raises(ValueError, match="empty"):
        T.topic_verdict("text", [], model=topics)

    seen = spark.sparkContext.accumulator(0)

    def entails():
        def score(said, sources):
            seen.add(len(said))
            return [0.9 if s.lower() in t.lower() else 0.8 for s, t in zip(said, sources)]

        return score

    asked = spark.createDataFrame([(1, 0, "A cat"), (1, 1, "A dog"), (2, 0, "A cat"), (2, 1, "A cat"), (3, 0, None)], "p int, ix int, sentence string")
    sources = spark.createDataFrame([(1, "see a cat"), (1, "see a cat"), (1, None), (2, "no")], "p int, text string")
    found = {(r.p, r.ix): r.grounded for r in G.entailed_sentences(asked, sources, entails, pool="p").collect()}
    assert found == {(1, 0): True, (1, 1): False, (2, 0): False, (2, 1): False, (3, 0): False}
    assert seen.value == 3


def test_learned_topics_agree_with_their_model(spark):
    from answerloom.operators import topics as L

    rows = [(i, "good words here " + ("awful\tterms" if i % 3 == 0 else "fine things") + f" n{i % 7}") for i in range(60)] + [(99, None), (100, "")]
    texts = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None if i % 5 else 1) for i in range(60)], "doc_id int, bad int, rare int")
    topics = L.fit_topics(texts, labels, {"bad": F.col("bad") == 1, "rare": F.col("rare") == 1})
    joined = {(r.doc_id, r.topic): r.score for r in L.learned_scores(texts, topics).collect()}
    assert len(joined) == 2 * len(rows) and all((joined[i, "bad"] > 0.8) == (i % 3 == 0) for i in range(60))
    model = L.topic_model(topics)()
    for key, text in rows:
        if text is not None:
            assert np.allclose(model([text], ["bad", "rare"])[0], [joined[key, "bad"], joined[key, "rare"]])
    with pytest.raises(ValueError, match="empty"):
        L.fit_topics(texts, labels, {})
    nobody = L.fit_topics(texts, labels.limit(0), {"bad": F.col("bad") == 1})
    assert L.learned_scores(texts, nobody).count() == 0
