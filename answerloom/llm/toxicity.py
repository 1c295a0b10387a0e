"""Toxicity of texts whose words are first restored by a noisy-channel decoder."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.llm._common import free_name, map_texts
from answerloom.session import cut_lineage

#: Letters of the language model: a to z, 27 for any other letter, 0 for a word's edge.
SYMBOLS = 28
EDGE, OTHER = 0, 27
#: What a written sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Signs put between the letters of a word, or in place of a vowel.
GAPS = " .-_*'~^"
#: Costs in nats: a sign read as a letter, a sign left out, a gap closed, a gap that ends a word, a
#: letter of a run left out, a star read as a vowel.
READ, DROP, CLOSE, BREAK, REPEAT, MASK = 0.7, 9.0, 0.3, 5.0, 0.4, 2.5
BEAM = 24
EDGES = ".,;:!?\"'()[]{}<>|&%#*/\\~^=+-_…«»“”‘’"
DOUBLED = re.compile(r"([^\W\d_])\1")
REPEATED = re.compile(r"([^\W\d_])\1\1")
#: A letter, digit or sign that may stand for one, and what may lie between two of a word: any run of blanks and ``GAPS``.
_LETTER = f"(?:[^\\W_]|[{re.escape(''.join(sign for sign in LEET if not sign.isalnum()))}])"
_PAUSE = rf"[\s{re.escape(GAPS)}]+"
SPACED = re.compile(rf"(?<![^\s\"'(]){_LETTER}(?:{_PAUSE}+{_LETTER}){{2,}}(?![^\s.,;:!?\"')])")
PAUSE = re.compile(_PAUSE)
JUNK = re.compile(r"([^\w\s])\1{2,}")
#: Words a task counts before it hands its counts on.
FLUSH = 500_000
MEMO = 200_000
#: The classifier learns from about so many labelled documents of each class, whole texts, and
#: from so many of their features.
PER_CLASS = 3000
FEATURES = 4096
LEAST_DOCUMENTS = 3


def _symbol(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else OTHER


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"]
        )
        found.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            found.update(w for w in (text or "").lower().split() if w.isalpha())
            if len(found) >= FLUSH:
                yield rows()
    if found:
        yield rows()


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Costs (negative log probabilities) of a letter after two others, of all words of ``docs``.

    Words are counted over every text, tasks counting first; the trigrams of each word weigh as
    often as it occurs. What reaches the driver is one row for each trigram of the 28 symbols, at
    most 21,952.
    """
    words = docs.select(text).mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    codes = F.concat(
        F.array(F.lit(EDGE), F.lit(EDGE)),
        F.transform(F.split("word", ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 96).otherwise(OTHER)),
        F.array(F.lit(EDGE)),
    )
    coded = words.where(F.length("word") > 0).select(codes.alias("c"), "n")
    places = F.sequence(F.lit(0), F.size("c") - 3)
    triples = coded.select(
        F.explode(
            F.transform(places, lambda i: (F.get("c", i) * SYMBOLS + F.get("c", i + 1)) * SYMBOLS + F.get("c", i + 2))
        ).alias("gram"),
        "n",
    )
    counted = triples.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(SYMBOLS**3)
    three[counted.column("gram").to_numpy()] = counted.column("n").to_numpy()
    three = three.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    flat = (one + 1) / (one + 1).sum()
    pairs = (two + 5 * flat) / (two.sum(axis=1, keepdims=True) + 5)
    triple = (three + 5 * pairs[None, :, :]) / (three.sum(axis=2, keepdims=True) + 5)
    return -np.log(triple)


def _arcs(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: what each written character may stand for, and at what cost; '' for nothing."""
    arcs = []
    for ix, sign in enumerate(token):
        if sign.isalpha():
            found = [(sign, 0.0)]
            if ix and token[ix - 1] == sign:
                found.append(("", REPEAT))
        elif sign in GAPS:
            found = [("", CLOSE), (" ", BREAK)]
            if sign == "*":
                found += [(vowel, MASK) for vowel in "aeiou"]
        else:
            found = [(letter, READ) for letter in LEET.get(sign, "")] + [("", DROP)]
            if ix and token[ix - 1] == sign:
                found.append(("", REPEAT))
        arcs.append(found)
    return arcs


def decode(token: str, costs: list) -> str:
    """The cheapest reading of a token, by Viterbi search over its lattice; it may hold spaces.

    The state is the last two letters; of equal costs the reading first in order wins. At most
    ``BEAM`` states go on from a character, of the few hundred there can be.
    """
    states: dict[tuple[int, int], tuple[float, str]] = {(EDGE, EDGE): (0.0, "")}
    for arcs in _arcs(token):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, said) in states.items():
            for letter, price in arcs:
                if letter == "":
                    state, found = (a, b), (cost + price, said)
                elif letter == " ":
                    if b == EDGE:
                        continue
                    state, found = (EDGE, EDGE), (cost + price + costs[a][b][EDGE], said + " ")
                else:
                    c = _symbol(letter)
                    state, found = (b, c), (cost + price + costs[a][b][c], said + letter)
                if state not in after or found < after[state]:
                    after[state] = found
        if len(after) > BEAM:
            after = dict(sorted(after.items(), key=lambda kv: kv[1])[:BEAM])
        states = after
    return min(((cost + costs[a][b][EDGE], said) for (a, b), (cost, said) in states.items()), default=(0.0, ""))[1]


class Restorer:
    """Words of texts, noisy ones restored. Readings are kept, up to ``MEMO`` of them."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.memo = costs.tolist(), {}

    def _read(self, token: str) -> list[str]:
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[token] = decode(token, self.costs).split()
        return found

    def _noisy(self, token: str) -> list[str]:
        """A token that is not letters alone: without its punctuation, if that leaves a word."""
        bare = JUNK.sub(" ", token).strip() if JUNK.search(token) else token
        if " " in bare:
            return [word for part in bare.split() for word in self._noisy(part)]
        word = bare.strip(EDGES)
        if not any(c.isalpha() for c in word):
            return []
        if bare[-1:] in "!+|" and any(c.isalpha() for c in bare):
            bare = bare.rstrip("!+|")
        start = bare.find(word)
        if start > 0 and bare[start - 1] in LEET:
            word = bare[start - 1] + word
        return self._letters(word) if word.isalpha() else self._read(word)

    def _letters(self, token: str) -> list[str]:
        """A token of letters alone: as written, unless it is stretched, and if a letter is doubled, as read."""
        if not DOUBLED.search(token):
            return [token]
        return self._read(token) if REPEATED.search(token) else [token, *self._read(token)]

    def words(self, text: str | None) -> set[str]:
        """The distinct words of a text, lower-cased, as written and as restored.

        Letters and signs standing alone are read together, and again without the first, the last
        and both, which may be words or signs of their own.
        """
        low = (text or "").lower()
        found: set[str] = set()
        for run in SPACED.findall(low) if SPACED.search(low) else ():
            letters = PAUSE.split(run)
            if not any(map(str.isalnum, letters)):
                continue
            for part in (letters, letters[1:], letters[:-1], letters[1:-1]) if len(letters) > 3 else (letters,):
                found.update(self._read(" ".join(part)))
        for token in set(low.split()):
            if token.isalpha():
                found.update(self._letters(token))
            else:
                found.update(self._noisy(token))
        return found


def features_of(words: Iterable[str]) -> set[str]:
    """Words, each marked by an end sign, and their beginnings of four to six letters."""
    found = set()
    for word in words:
        found.add(word + "$")
        if len(word) >= 4:
            found.update((word[:4], word[:5], word[:6]))
    return found


@dataclass(frozen=True)
class Model:
    """Character costs, a weight for each feature that counts, and the weight that is always added."""

    costs: np.ndarray
    weights: dict[str, float]
    bias: float

    def score(self, words: set[str]) -> float:
        get, total = self.weights.get, self.bias
        seen = set()
        for word in words:
            for feature in (word + "$", word[:4], word[:5], word[:6]) if len(word) >= 4 else (word + "$",):
                weight = get(feature)
                if weight is not None and feature not in seen:
                    seen.add(feature)
                    total += weight
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, total))))


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, per_class: int) -> DataFrame:
    """About ``per_class`` labelled rows of each class: ``text``, ``toxic``; and their classes' sizes.

    The ids drawn are about twice ``per_class`` at any size of the input, so they are sent to the
    documents, and the rows found are written once for the passes over them.
    """
    said = labels.where("toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in said.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("toxic") == label, min(1.0, per_class / n)).otherwise(share)
    picked = said.where(drawn < share)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return cut_lineage(rows.join(F.broadcast(picked), "id").select("text", "toxic")), sizes


def _count_features(costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs.value)
        found: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[int(toxic > 0)].update(features_of(restorer.words(text)))
        both = list(found[0].keys() | found[1].keys())
        for at in range(0, len(both), 50_000):
            part = both[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([counts[f] for f in part], pa.int64()) for counts in found)],
                ["feature", "clean", "toxic"],
            )

    return run


def _logistic(rows: list[np.ndarray], labels: np.ndarray, width: int, penalty: float = 0.5, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on rows of active features, by gradient steps with momentum.

    Both classes weigh the same, however many rows they have.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    columns = np.concatenate(rows) if len(at) else np.zeros(0, np.int64)
    weights, bias, pace, push = np.zeros(width), 0.0, np.zeros(width), 0.0
    used = np.maximum(np.bincount(columns, minlength=width), 1)
    share = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    for _ in range(steps):
        odds = bias + np.bincount(at, weights[columns], minlength=len(rows))
        miss = share * (labels - 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        slope = np.bincount(columns, miss[at], minlength=width) - penalty * weights
        pace = 0.9 * pace + 0.2 * slope / np.sqrt(used) / np.sqrt(len(rows))
        push = 0.9 * push + 0.2 * miss.mean()
        weights, bias = weights + pace, bias + push
    return weights, bias


def fit(
    docs: DataFrame,
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    per_class: int = PER_CLASS,
    features: int = FEATURES,
) -> Model:
    """The language model of all ``docs`` and a classifier of restored words from ``labelled`` ones.

    ``labelled`` has the id and ``toxic``; rows without a label are left out. The classifier sees
    about ``per_class`` documents of each class, drawn by a hash of the id, and the ``features``
    that tell the classes apart best. Without labelled rows every score is 0; with one class
    only, every score is that class.
    """
    costs = language_model(docs, text)
    labels = labelled.select(F.col(doc_id).alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    sample, sizes = _sample(docs, labels, doc_id, text, per_class)
    if len(sizes) < 2:
        return Model(costs, {}, 30.0 if sizes.get(1) else -30.0)
    shared = docs.sparkSession.sparkContext.broadcast(costs)
    counts = (
        sample.mapInArrow(_count_features(shared), "feature string, clean bigint, toxic bigint")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    seen = min(per_class, sizes[0]), min(per_class, sizes[1])
    clean, toxic = (F.col("clean") + 0.5) / (seen[0] + 1.0), (F.col("toxic") + 0.5) / (seen[1] + 1.0)
    apart = F.abs(toxic - clean) / F.sqrt(toxic + clean)
    best = (
        counts.where(F.col("clean") + F.col("toxic") >= LEAST_DOCUMENTS)
        .orderBy(apart.desc(), "feature")
        .limit(features)
        .select("feature")
        .toArrow()
        .column("feature")
        .to_pylist()
    )
    place = docs.sparkSession.sparkContext.broadcast({feature: ix for ix, feature in enumerate(best)})

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(shared.value), place.value
        for batch in batches:
            rows = [sorted(known[f] for f in features_of(restorer.words(t)) if f in known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], ["active", "toxic"])

    learned = sample.mapInArrow(active, "active array<int>, toxic int").toArrow()
    rows = [np.array(r, np.int64) for r in learned.column("active").to_pylist()]
    weights, bias = _logistic(rows, np.array(learned.column("toxic").to_pylist(), np.float64), len(best))
    return Model(costs, {f: w for f, w in zip(best, weights.tolist(), strict=True) if abs(w) > 1e-3}, float(bias))


def score_texts(docs: DataFrame, model: Model, text: str, carry: list[str], name: str = "score") -> DataFrame:
    """``carry`` and the score of each text, from 0 to 1.

    Null and empty texts get the score of a text without words. Rows are kept as they are,
    repeats included; the name of the score gets underscores in front if it clashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[str | None]) -> list[list[float]]:
        known = shared.value
        restorer = _restorer(known)
        return [[known.score(restorer.words(t)) for t in texts]]

    return map_texts(docs, text, carry, [T.StructField(free_name(carry, name), T.DoubleType())], compute)


_KEPT: list[tuple[Model, Restorer]] = []


def _restorer(model: Model) -> Restorer:
    """The restorer of a model, kept for the next batch of the same task."""
    if not _KEPT or _KEPT[0][0] is not model:
        _KEPT[:] = [(model, Restorer(model.costs))]
    return _KEPT[0][1]
