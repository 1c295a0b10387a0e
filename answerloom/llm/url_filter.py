"""Allow and block pages: host and path rules, then a list of URLs behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm._common import free_name
from answerloom.session import cut_lineage

#: (verdict, host, path), as given.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Query parameters that say where a visitor came from, not what is shown.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
#: Hosts whose pages are listed for blocking, in the query of this operator.
LISTED_HOSTS = ("spam-farm", "casino-win", "cheap-pills", "free-bets")
#: A block is 8 words of 32 bits; a URL sets one bit in each word of one block.
WORDS = 8
KEYS_PER_BLOCK = 20
#: The filter is sent to all executors up to so many bytes and joined by block beyond.
BROADCAST_BYTES = 32 << 20
BLOCK_BYTES = 64


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column, host: Column, path: Column) -> Column:
    """One spelling of a URL: no scheme, ``www.``, fragment, tracking parameters, ``.html`` or last slash.

    The other parameters stay as they are written. A URL without a host is null.
    """
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    own = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(=|\z)"))
    bare = F.regexp_replace(F.regexp_replace(path, r"\.html?\z", ""), r"/+\z", "")
    asked = F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(own, "&"))).otherwise("")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), bare, asked))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null if none does.

    A rule fits its host and all subdomains if the path starts with its path. Of rules of one
    length the first given wins.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, suffix, prefix in reversed(ordered):
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, suffix + prefix).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """The bit a key sets in each word of its block."""
    drawn = F.xxhash64(key, F.lit("bits"))
    return [
        F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(drawn, 5 * ix).bitwiseAND(F.lit(31)).cast("int"))
        for ix in range(WORDS)
    ]


def block_count(listed: int) -> int:
    return max(1, -(-listed // KEYS_PER_BLOCK))


def build_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block`` and its words: the bits of all keys of the block, or-ed before they are shuffled."""
    words = [f"w{ix}" for ix in range(WORDS)]
    marked = listed.select(_block(F.col(key), blocks).alias("block"), *(b.alias(w) for b, w in zip(_bits(F.col(key)), words, strict=True)))
    return marked.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in words))


def listed_pages(pages: DataFrame, listed: DataFrame, key: str = "canonical") -> DataFrame:
    """``pages`` with ``listed``: whether ``key`` is among the distinct, non-null keys of ``listed``.

    The filter sorts out pages that surely are not listed; the others are looked up by an exact
    join on the key itself, so the answer has no false positives. A filter that is too large to
    send is joined by block, which leaves the result the same.
    """
    known = cut_lineage(listed.select(F.col(key)).where(F.col(key).isNotNull()).distinct())
    blocks = block_count(known.count())
    built = cut_lineage(build_filter(known, key, blocks))
    side = F.broadcast(built) if built.count() * BLOCK_BYTES <= BROADCAST_BYTES else built
    passed = reduce(
        lambda a, b: a & b,
        (F.coalesce(F.col(f"w{ix}").bitwiseAND(bit) != 0, F.lit(False)) for ix, bit in enumerate(_bits(F.col(key)))),
    )
    asked = pages.withColumn("block", _block(F.coalesce(key, F.lit("")), blocks)).join(side, "block", "left")
    maybe = asked.withColumn("maybe", F.coalesce(passed & F.col(key).isNotNull(), F.lit(False))).select(*pages.columns, "maybe")
    exact = known.select(key, F.lit(True).alias("listed"))
    hits = maybe.where("maybe").join(exact, key, "left").select(*pages.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    return hits.union(maybe.where(~F.col("maybe")).select(*pages.columns, F.lit(False).alias("listed")))


def judge(
    pages: DataFrame,
    listed_urls: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``listed`` for each page.

    ``listed_urls`` has a column ``url``. A rule's verdict comes first; without one a page whose
    canonical URL is listed is blocked and all others are allowed. A null URL or one without
    ``://`` has an empty host and path, no rule and is allowed. Repeated rows stay repeated; empty
    tables are fine; other columns are not read.
    """
    of = F.col(url)
    marked = pages.select(F.col(page_id).alias(page_id), of.alias("_url"), host_of(of).alias("host"), path_of(of).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    asked = marked.select(
        page_id, "host", "path", rule.alias("rule"), said.alias("said"),
        canonical_url(F.col("_url"), F.col("host"), F.col("path")).alias("canonical"),
    )
    other = F.col("url")
    listed = listed_urls.select(canonical_url(other, host_of(other), path_of(other)).alias("canonical"))
    verdict = F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow"))
    return listed_pages(asked, listed).select(page_id, "host", "path", "rule", verdict.alias("verdict"), "listed")


def listed_hosts(pages: DataFrame, url: str = "url", names: Sequence[str] = LISTED_HOSTS) -> DataFrame:
    """The URLs of pages with a label of ``names`` in their host."""
    labels = F.split(host_of(F.col(url)), r"\.")
    return pages.select(F.col(url).alias("url")).where(F.arrays_overlap(labels, F.array(*map(F.lit, names))))
