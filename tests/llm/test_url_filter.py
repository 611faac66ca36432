from parley.llm import queries, url_filter


def test_rules(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("a.org", "/x", "block")], "host string, path string, verdict string")
    rows = [("http://Sub.Example.NET/en/1?x=/de/", "allow", "example.net/en/"), ("ftp://example.net/fr/#a", "block", "net/"), ("http://net", "allow", None), ("http://notexample.com/de/", "allow", None), ("https://www.example.com/de/x", "block", "example.com/de/"), (None, "allow", None), ("no scheme", "allow", None), ("http://a.org/xyz", "block", "a.org/x"), ("http://a.org/fr/", "allow", "org/fr/"), ("://", "allow", None), ("http://a.org/fr/", "allow", "org/fr/")]
    urls = spark.createDataFrame([(i, u, "old") for i, (u, _, _) in enumerate(rows)], "page_id long, url string, rule string")
    got = {r.page_id: (r.verdict, r.rule) for r in url_filter.judge(urls, rules).collect()}
    assert got == {i: (v, r) for i, (_, v, r) in enumerate(rows)}
    assert url_filter.judge(urls.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(urls, rules.limit(0)).collect()} == {"allow"}


def test_join_is_by_the_short_prefix_alone(spark, monkeypatch):
    rules = spark.createDataFrame([*queries.URL_RULES, ("Ä.de", "/", "block")], "host string, path string, verdict string")
    urls = spark.createDataFrame([(0, "http://a.net/x"), (1, "http://x.Ä.de/"), (2, "http://x.ä.de/"), (3, None)], "page_id long, url string")
    plan = url_filter.judge(urls, rules)._jdf.queryExecution().executedPlan().toString()
    assert "[_key#" in plan and "_digest" not in plan.split("Join [_key#")[1].split("]")[0]
    want = {0: "net/", 1: "Ä.de/", 2: None, 3: None}
    assert {r.page_id: r.rule for r in url_filter.judge(urls, rules).collect()} == want
    monkeypatch.setattr(url_filter, "SHORT", 0)
    assert {r.page_id: r.rule for r in url_filter.judge(urls, rules).collect()} == want
