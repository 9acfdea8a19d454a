from plantledger.llm.url_filter import Rule, judge_urls

RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def judged(spark, urls):
    rows = [(i, u, "x") for i, u in enumerate(urls)]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), RULES).collect()
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(out, key=lambda r: r["_id"])]


def test_rules_and_parts(spark):
    got = judged(spark, ["http://A.Example.NET/en/1?x=/#y", "http://example.net/de/", "https://www.example.com/de/4#t", "http://anexample.com/de/4",
                         "ftp://x.org/fr/", "http://x.net", "http://x.net?q", "no scheme", None, "", "a://b://c/d", "http://É.Net/Ab"])
    assert got[:5] == [("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de/", "net/", "block"),
                       ("www.example.com", "/de/4", "example.com/de/", "block"), ("anexample.com", "/de/4", None, "allow"), ("x.org", "/fr/", "org/fr/", "allow")]
    assert got[5][:3] == ("x.net", "", None) and got[6][:3] == ("x.net", "", None)
    assert [g[:3] for g in got[7:10]] == [("", "", None)] * 3
    assert got[10][:2] == ("b:", "//c/d") and got[11][:3] == ("É.net", "/Ab", "net/")


def test_held_out_names(spark):
    bad = ["https://www.big-casino.example.com/en/1", "http://cheap-pills-4u.example.org/de/2", "https://blog.adult-x-tube.example.com/fr/3",
           "http://m.spam-farm9.example.org/en/4.html", "https://ads-tracker.example.com/es/5", "https://free-bets-club.example.org/en/6"]
    good = ["https://www.lionthe.example.com/en/1", "http://bakery.example.org/de/2", "https://blog.resting.example.com/fr/3",
            "http://m.hilltown.example.org/en/4.html", "https://tionbleshe.example.com/es/5", "https://thandredouth.example.org/en/6"]
    assert [g[3] for g in judged(spark, bad)] == ["block"] * len(bad)
    assert [g[3] for g in judged(spark, good)] == ["allow"] * len(good)


def test_repeated_rows_and_empty_table(spark):
    assert len(judged(spark, ["http://a.org/fr/"] * 3)) == 3
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
