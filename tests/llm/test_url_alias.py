import duckdb

from trackloom.llm import url_alias

PAGES = [
    (1, "http://a.org/en/1", '<link rel="canonical" href="http://x.example.com/en/1">'),  # alias of a blocked one
    (2, "http://b.org/en/2", "<meta http-equiv='refresh' content='0; url=http://A.org/en/1'>"),  # chain
    (3, "http://c.org/q", '<LINK REL=canonical HREF=http://c2.org/q>'),
    (4, "http://c2.org/q#top", "x"),
    (5, "https://d.org/w", '<link href="http://example.com/en/1" rel="canonical"><meta http-equiv="refresh" content="1;url=http://z.net/de/9">'),  # allow takes precedence
    (6, "nothing", None),
    (7, None, None),
    (8, "http://Example.NET/de/8x?y=1", ""),
    (9, "http://net/de/", ""),
    (10, "http://notcom/en/", ""),
    (11, "http://a.org/en/1", ""),  # repeated
    (12, "http://e.org/dir/page?x#y", '<link rel="canonical" href="other">'),
    (13, "http://e.org/dir/other", '<link rel="canonical" href="/es/1">'),
    (14, "http://q?://com/en/", "long " * 50_000),
]
VERDICTS = {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "allow", 11: "block", 12: "block", 13: "block", 14: "allow"}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, verdict string")


def test_aliases_share_decisions(spark):
    got = {r.page_id: r for r in url_alias.judge(frame(spark, PAGES)).collect()}
    assert {k: r.verdict for k, r in got.items()} == VERDICTS
    assert got[8].rule == "example.net/de/8" and (got[8].host, got[8].path) == ("example.net", "/de/8x")
    assert (got[7].host, got[7].path, got[7].rule) == ("", "", None)
    assert (got[14].host, got[14].path) == ("q", "")


def test_sql_agrees(spark):
    pages = frame(spark, PAGES).toPandas()  # noqa: F841
    want = sorted(duckdb.sql(f"select page_id, host, path, rule, verdict from ({url_alias.oracle()})").fetchall())
    assert sorted(map(tuple, url_alias.judge(frame(spark, PAGES)).collect())) == want


def test_no_pages(spark):
    assert url_alias.judge(frame(spark, [])).count() == 0
