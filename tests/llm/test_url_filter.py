from blkscope.llm import url_filter as U


def judge(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    ends = [k for k, c in enumerate(rest) if c in "/?#"] + [len(rest)]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[: ends[0]])
    tail = rest[ends[0] :]
    path = tail[: min([k for k, c in enumerate(tail) if c in "?#"] + [len(tail)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = [
    (1, "http://example.com/en/x"), (2, "http://www.EXAMPLE.com/en/"), (3, "http://a.www.example.com/en/y?z#w"), (4, "https://x.net/es/1"),
    (5, "https://x.net/fr"), (6, "https://x.net"), (7, None), (8, "no scheme"), (9, "x://"), (10, "http://com"), (11, "http://com/"),
    (12, "http://notexample.com/en/"), (13, "http://h?x=http://b.net/es/"), (14, "http://ÄB.com/é"), (15, "http://com./"), (16, "http://" + "a." * 500 + "net/es/" + "y" * 5000),
    (17, ""), (None, "http://example.com/en/"), (18, "a://b://c.com/"), (1, "http://example.com/en/x"), (19, "http://x.net/es/"), (19, "http://x.net/fr/"),
]


def test_against_brute_force(spark, pages):
    rows = URLS + [(r.page_id, r.url) for r in pages.collect()]
    df = spark.createDataFrame([(i, u, 1, "r") for i, u in rows], "page_id long, url string, copies int, rule string")
    got = U.url_filter(df, U.rules_table(spark, U.RULES))
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *judge(u, U.RULES)) for i, u in rows), key=str)


def test_short_prefixes_are_confirmed(spark):
    rules = [("com", "/", "allow"), ("a.com", "/b", "block"), ("b.com", "/", "block"), ("b.com", "/", "allow")]
    df = spark.createDataFrame(URLS + [(50, "http://a.com/bc"), (51, "http://b.com/")], "page_id long, url string")
    for prefix in (1, 64):
        got = {(r.page_id, r.rule, r.verdict) for r in U.url_filter(df, U.rules_table(spark, rules), prefix=prefix).collect()}
        assert (50, "a.com/b", "block") in got and (51, "b.com/", "block") in got and (8, None, "allow") in got


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.url_filter(df, U.rules_table(spark, U.RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert U.url_filter(one, U.rules_table(spark, [])).collect()[0].verdict == "allow"
