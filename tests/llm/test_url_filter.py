from __future__ import annotations

from answerloom.llm import url_filter as U


def verdicts(spark, urls, listed=()):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    known = spark.createDataFrame([(u,) for u in listed], "url string")
    return {r.page_id: r for r in U.judge(pages, known).collect()}


def test_rules_hosts_and_paths(spark):
    got = verdicts(spark, [
        "HTTP://A.Example.ORG/es/1?x=1", "https://example.org/en/12#t", "https://example.org/en/21", "https://notexample.org",
        "https://x.com/fr/1", "https://x.com/de/", "https://com/fr/", "https://xcom/fr/", None, "no scheme", "", "a://b://c/d?e",
    ])
    seen = [(r.host, r.path, r.rule, r.verdict) for _, r in sorted(got.items())]
    assert seen == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/en/21", "org/", "allow"), ("notexample.org", "", None, "allow"),
        ("x.com", "/fr/1", "com/fr/", "allow"), ("x.com", "/de/", "com/de/", "block"), ("com", "/fr/", "com/fr/", "allow"),
        ("xcom", "/fr/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("b:", "//c/d", None, "allow"),
    ]


def test_listed_urls_by_canonical_form(spark):
    got = verdicts(
        spark,
        ["http://www.bad.net/a.html?utm_source=x#y", "https://bad.net/a/", "https://bad.net/ab", "https://bad.net/a?page=2", "https://bad.org/a"],
        ["https://bad.net/a", "https://bad.org/a", None, "nothing"],
    )
    assert [r.verdict for _, r in sorted(got.items())] == ["block", "block", "allow", "allow", "allow"]
    assert [r.listed for _, r in sorted(got.items())] == [True, True, False, False, True]


def test_filter_passes_every_listed_key_and_joins_by_block_too(spark, monkeypatch):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "canonical string")
    pages = spark.createDataFrame([(f"k{i}",) for i in range(0, 6000, 2)] + [(None,), ("k0",)], "canonical string")
    for limit in (U.BROADCAST_BYTES, 0):
        monkeypatch.setattr(U, "BROADCAST_BYTES", limit)
        found = U.listed_pages(pages, keys).collect()
        assert len(found) == 3002
        assert all(r.listed == (r.canonical is not None and int(r.canonical[1:]) < 3000) for r in found)


def test_empty_tables(spark):
    assert verdicts(spark, []) == {}
    assert verdicts(spark, ["https://a.net/"])[0].verdict == "allow"
