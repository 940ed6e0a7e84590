from lossframe.llm import catalog
from lossframe.llm.url_filter import SiteRule, Vocabulary, filter_urls

URLS = {
    0: "https://WWW.Example.ORG/es/9?x=1", 1: "https://example.org/en/17", 2: "http://a.example.org/en/2",
    3: "http://shop.com/de/1#/fr/", 4: "http://com/fr/x", 5: None, 6: "no scheme casino", 7: "http://x.org",
    8: "http://notcom/de/", 9: "https://cheap-pills.example.net/a", 10: "https://cheapest.net/pillstore",
    11: "https://a.net/cheap/cheap", 12: "", 13: "http://a.net/%E9cheapépills", 14: "ftp://h?q#f", 15: "http://://x",
}


def test_rules_and_vocabulary(spark, sf):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in URLS.items()],
                                  "page_id long, url string, html string, verdict int")
    rows = {r.page_id: r for r in catalog.op4_url_filter(spark, sf(pages=pages)).collect()}
    got = {i: (r.host, r.path, r.rule, r.verdict) for i, r in rows.items()}
    assert got == {
        0: ("www.example.org", "/es/9", "example.org/es/", "block"),
        1: ("example.org", "/en/17", "example.org/en/1", "block"),
        2: ("a.example.org", "/en/2", "org/", "allow"),
        3: ("shop.com", "/de/1", "com/de/", "block"),
        4: ("com", "/fr/x", "com/fr/", "allow"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "block"),          # one strict term
        7: ("x.org", "", None, "allow"),     # an empty path starts with no rule's path
        8: ("notcom", "/de/", None, "allow"),
        9: ("cheap-pills.example.net", "/a", None, "block"),   # two soft terms
        10: ("cheapest.net", "/pillstore", None, "allow"),     # not bounded
        11: ("a.net", "/cheap/cheap", None, "allow"),          # one distinct soft term
        12: ("", "", None, "allow"),
        13: ("a.net", "/%E9cheapépills", None, "allow"),  # %E9cheap is bounded by '9'
        14: ("h", "", None, "allow"),
        15: (":", "//x", None, "allow"),
    }
    assert catalog.op4_url_filter(spark, sf(pages=pages.limit(0))).count() == 0


def test_empty_vocabulary_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/casino"), (2, None)], "page_id long, url string")
    rows = {r.page_id: r for r in filter_urls(pages, [SiteRule("a.org", "/c", "block")], Vocabulary((), ())).collect()}
    assert (rows[1].verdict, rows[1].terms, rows[2].verdict, rows[2].term_weight) == ("block", "", "allow", 0)
    assert {r.verdict for r in filter_urls(pages, [], Vocabulary((), ())).collect()} == {"allow"}
