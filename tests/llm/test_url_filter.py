from __future__ import annotations

from cytoplan.llm.url_filter import url_filter


def judged(spark, urls):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.strict_terms, r.soft_terms) for r in url_filter(pages).collect()}


def test_rules_and_vocabulary(spark):
    got = judged(
        spark,
        [
            "http://A.Example.NET/en/x?casino=1",
            "http://example.net/fr/",
            "https://x.org/fr/free-win-deal",
            "https://sub.example.com/de/a#b",
            "https://good.info/Essex/casinos",
            "https://good.info/a?go=XXX",
            "https://good.info/free/free",
            "https://good.info/free/win",
            None,
            "no scheme casino",
            "",
            "http://example.net",
            "ftp://notexample.com/de/",
            "http://b.c/poker\n-bet?x",
        ],
    )
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow", 1, 0)
    assert got[1][:4] == ("example.net", "/fr/", "net/", "block")
    assert got[2][2:] == ("org/fr/", "allow", 0, 3)
    assert got[3][:4] == ("sub.example.com", "/de/a", "example.com/de/", "block")
    assert got[4][2:] == (None, "allow", 0, 0)
    assert got[5][3:] == ("block", 1, 0)
    assert got[6][3:] == ("allow", 0, 1)
    assert got[7][3:] == ("block", 0, 2)
    assert got[8] == ("", "", None, "allow", 0, 0)
    assert got[9] == ("", "", None, "block", 1, 0)
    assert got[10] == ("", "", None, "allow", 0, 0)
    assert got[11][:4] == ("example.net", "", None, "allow")
    assert got[12][2:4] == (None, "allow")
    assert got[13][3:] == ("block", 0, 2)


def test_long_repeated_and_nameless_pages(spark):
    long = "https://good.info/" + "a-" * 500_000 + "casino/" + "b" * 1_000_000
    rows = [(None, long), (None, long), (1, "http://x.org/fr/"), (1, "http://x.org/fr/"), (1, None)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, hits int")
    got = sorted((str(r.page_id), r.verdict, str(r.rule), r.strict_terms) for r in url_filter(pages).collect())
    assert got == [("1", "allow", "None", 0), ("1", "allow", "org/fr/", 0), ("1", "allow", "org/fr/", 0), ("None", "block", "None", 1), ("None", "block", "None", 1)]


def test_empty(spark):
    assert judged(spark, []) == {}
