from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from answerloom.llm import token_alignment as A
from answerloom.llm.queries import TOKENIZERS, op12_token_alignment

FIRST, SECOND = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def files():
    return A.Vocabularies.read(FIRST, SECOND)


class Plain:
    """Both tokenizers on whole texts, and overlaps of byte ranges by two loops."""

    def __init__(self, files):
        import sentencepiece

        self.first = Tokenizer.from_file(FIRST)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
        self.bytes = [column.to_pylist() for column in A.load(files).bytes_of]

    def groups(self, text):
        """``[(ids of A, ids of B)]`` and all overlapping pairs; nothing if the bytes differ."""
        if not text:
            return [], []
        ids = self.first.encode(" " + text, add_special_tokens=False).ids, self.second.encode(text)
        if any(b"".join(self.bytes[s][i] for i in ids[s]) != (" " + text).encode() for s in (0, 1)):
            return [], []
        ranges = []
        for s in (0, 1):
            at, found = 0, []
            for i in ids[s]:
                found.append((at, at + len(self.bytes[s][i]), i))
                at = found[-1][1]
            ranges.append(found)
        ends = sorted({r[1] for r in ranges[0]} & {r[1] for r in ranges[1]})
        groups, start = [], 0
        for end in ends:
            groups.append(tuple([i for a, b, i in side if a >= start and b <= end] for side in ranges))
            start = end
        links = [(i, j) for a, b, i in ranges[0] for c, d, j in ranges[1] if a < d and c < b]
        return groups, links

    def rows(self, texts):
        found = [self.groups(text) for text in texts]
        counts = Counter(link for _, links in found for link in links)
        top = Counter()
        for (_, j), n in counts.items():
            top[j] = max(top[j], n)
        for groups, links in found:
            said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            yield (
                sum(len(a) for a, _ in groups),
                sum(len(b) for _, b in groups),
                len(groups),
                len(links),
                sum(counts[link] == top[link[1]] for link in links),
                sum(counts[link] for link in links),
                said,
            )


def texts_of(n, seed):
    pick = random.Random(seed)
    parts = ["the", "idea", "Straße", "naïve", "日本語", "🙂", "é", "x" * 40, "don't", "'s", "12345", "<|endoftext|>", "</s>"] * 4 + ["▁", "a▁b"]
    gaps = [" "] * 8 + ["  ", "\n", " \n", "\t ", " ", "　 ", "", ".\n", "\x00", "\x85 ", " "]
    return ["".join(pick.choice(parts) + pick.choice(gaps) for _ in range(pick.randrange(30))) for _ in range(n)]


def test_equal_to_whole_texts_and_two_loops(spark, files):
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", *texts_of(250, 1)]
    rows = spark.createDataFrame([(ix, text) for ix, text in enumerate(texts)], "doc_id int, text string").repartition(3)
    names = "n_a n_b n_groups n_links n_best count_sum groups".split()
    wanted = dict(enumerate(Plain(files).rows(texts)))
    for limit in (200, 1 << 20):
        found = {r.doc_id: tuple(r[name] for name in names) for r in A.align(rows, files, limit=limit).collect()}
        assert found == wanted
    assert sum(w[0] > 0 for w in wanted.values()) > 100 and sum(w[0] == 0 for w in wanted.values()) > 20


def test_query_on_documents(spark, files):
    found = {r.doc_id: r for r in op12_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = {d.doc_id: d.text for d in docs if len(d.text) < 3000}
    plain = Plain(files)
    assert len(found) == len(docs)
    for key, text in short.items():
        groups, links = plain.groups(text)
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        r = found[key]
        assert (r.n_groups, r.n_links, r.n_links) == (len(groups), len(links), r.n_a + r.n_b - r.n_groups)
        assert r.groups_sha256 == (hashlib.sha256(said.encode()).hexdigest() if said else "")
        assert r.n_best <= r.n_links <= r.count_sum


def test_file_out_of_order_is_read_by_its_own_encoder(files):
    tokens, slow = A.Tokenizers(files), A.Tokenizers(files)
    slow._first = None
    texts = pa.array([t for t in texts_of(60, 2) if t], pa.large_string())
    assert tokens._first is not None and tokens.first(texts).to_pylist() == slow.first(texts).to_pylist()


def test_awkward_rows(spark, awkward, nothing, files):
    carry = [*awkward.columns]
    named = awkward.withColumnRenamed("n_chars", "n_a")
    found = A.align(named, files, carry=named.columns)
    assert found.columns[: len(carry)] == named.columns and "_n_a" in found.columns
    rows = found.collect()
    assert len(rows) == awkward.count()
    empty = [r for r in rows if r.doc_id in (3, 4)]
    assert all((r["_n_a"], r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == (0, 0, 0, 0, 0, 0, "") for r in empty)
    assert len({(r.groups, r.n_best, r.count_sum) for r in rows if r.doc_id in (1, 2)}) == 1
    assert all(r.n_links == r["_n_a"] + r.n_b - r.n_groups > 0 for r in rows if r.doc_id not in (3, 4))
    assert A.align(nothing, files).count() == 0
