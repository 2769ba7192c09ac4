"""The site rules of op8 are those of its contract, word by word."""

from geoloom.llm import queries, url_rules


def test_site_rules_are_the_contracts(spark):
    assert dict(queries.SITES) == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    # a rule that allows a site stands above the method's own verdict
    urls = ["http://x.net/de/8", "http://x.net/de/cheap-pills/", "http://example.net/de/7", "http://example.net/de/8", "http://x.net/fr/cheap-pills/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(rows, [*(url_rules.site(*s) for s in queries.SITES), *url_rules.PATTERNS]).collect()}
    assert [got[i] for i in range(len(urls))] == [("net/de/", "allow")] * 3 + [("example.net/de/8", "block"), (None, "block")]
