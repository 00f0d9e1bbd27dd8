from urllib.parse import urlparse

from pyspark.sql import functions as F

from codexferry.functions import urls as U

ADDRESSES = {
    "https://a.example/x/y/": "https://a.example/x/y",
    "https://a.example/x///": "https://a.example/x",
    "http://a.example": "http://a.example",
    "http://a.example/": "http://a.example",
    "https://a.example/p;v=1/q;w=2;z": "https://a.example/p;v=1/q",
    "https://a.example/p?b=1&c=2#frag": "https://a.example/p?b=1&c=2",
    "https://a.example/p?b=1&utm_source=x": "https://a.example/p",
    "https://a.example/p?locale=de": "https://a.example/p",
    "https://a.example?q=1/": "https://a.example?q=1/",
    "https://a.example#top": "https://a.example",
    "https://a.example/a b/%zz|x##y": "https://a.example/a b/%zz|x",
    "https://U:p@A.Example:8080/P": "https://U:p@A.Example:8080/P",
    "https://a.exa\tmple/x\n": "https://a.example/x",
    "https://[::1]:80/x": "https://[::1]:80/x",
    "https://a.example/x?": "https://a.example/x",
    "http:///path": "http:///path",
}


def test_canonicalize_url(column):
    assert column(U.canonicalize_url, list(ADDRESSES)) == list(ADDRESSES.values())


def test_parts_match_urlparse(column):
    for url, parts in zip(ADDRESSES, column(U.url_parts, list(ADDRESSES))):
        want = urlparse(url)
        assert (parts.scheme, parts.netloc, parts.path, parts.query, parts.fragment) == (
            want.scheme, want.netloc, want.path, want.query, want.fragment,
        )


def test_invalid_hosts(column):
    values = ["http://[::1/x", "http://::1]/x", "http://[zz]/x", "http://[::1]/x", "http://ok/[x]"]
    got = column(lambda c: U.url_is_valid(U.url_parts(c)), values)
    assert got == [False, False, False, True, True]


def test_host_validity_matches_urlparse(column):
    hosts = ["a.x", "a\u2100b.x", "a\uff0fb", "a\uff1ab", "b\u00fccher.x", "\u2488x", "a\uff20b", "u@h:1"]
    urls = [f"http://{h}/p" for h in hosts]

    def parses(url):
        try:
            return bool(urlparse(url))
        except ValueError:
            return False

    assert column(lambda c: U.url_is_valid(U.url_parts(c)), urls) == [parses(u) for u in urls]


def test_blocked_links(column):
    values = {
        "https://twitter.com/a": (False, False),
        "https://www.microsoft.com/a": (False, True),  # holds t.co
        "https://reddit.com/a": (False, True),
        "https://x.example/cartography": (False, True),
        "https://x.example/cart/1": (False, False),
        "https://x.example/Login": (False, False),
        "https://accounts.google.com/x": (False, False),
        "https://x.example/wiki/Special:Random": (False, False),
        "https://x.example/a?action=edit": (False, False),
        "https://x.example/a?printable=yes": (False, False),
        "https://x.example/a": (True, True),
    }
    for i, match in enumerate(("substring", "exact")):
        got = column(lambda c: U.link_not_blocked(U.url_parts(c), match), list(values))
        assert got == [v[i] for v in values.values()], match


def _best(spark, title, hrefs, **options):
    df = spark.createDataFrame([(title, hrefs)], "title string, hrefs array<string>")
    return df.select(U.best_link(F.col("title"), F.col("hrefs"), **options).alias("b")).first().b


def _score(spark, title, url, position=0):
    df = spark.createDataFrame([(title, url)], "title string, url string")
    score = U.link_score(U.url_parts(F.col("url")), F.lit(position), U.title_hints(F.col("title")))
    return df.select(score.alias("s")).first().s


def test_each_score_rule(spark):
    cases = [
        # fragment
        ("zzz", "https://h.example/p#bodyContent", 0, 80.0),
        ("zzz", "https://h.example/p#overview", 3, 50.0),
        ("zzz", "https://h.example/p#other", 0, 10.0),
        ("zzz", "https://h.example/p", 0, 0.0),
        # title tokens: share * 40, then 8 each; repeats count, stop words do not
        ("solar panel guide", "https://h.example/solar-panel", 0, 2 / 3 * 40.0 + 16.0),
        ("solar solar", "https://h.example/solar", 0, 40.0 + 16.0),
        ("how the solar", "https://h.example/how/the/solar", 0, 40.0 + 8.0),
        ("the and", "https://h.example/the", 0, 0.0),
        ("ab cd", "https://h.example/ab/cd", 0, 0.0),
        # site tokens: one letter is enough, stop words count
        ("zzz - Acme", "https://www.acme.example/q", 0, 15.0),
        ("zzz | The", "https://the.example/q", 0, 15.0),
        ("zzz - m", "https://h.example/q", 0, 15.0),
        # the last part counts
        ("zzz - acme - other", "https://acme.example/q", 0, 0.0),
        # home pages
        ("zzz", "https://h.example/", 0, -20.0),
        ("zzz", "https://h.example/en", 0, -20.0),
        ("zzz", "https://h.example/EN", 0, -20.0),
        ("zzz", "https://h.example/blog/", 0, 0.0),
        # wiki: slug of the title, plus tokens and site
        ("Deep Sea - Wikipedia", "https://en.wikipedia.org/wiki/Deep_Sea", 0,
         2 / 2 * 40.0 + 16.0 + 100.0 + 15.0),
        ("Deep Sea - Wikipedia", "https://en.wikipedia.org/wiki/Deep_Sea_fish", 0,
         2 / 2 * 40.0 + 16.0 + 15.0),
    ]
    for title, url, position, want in cases:
        assert _score(spark, title, url, position) == want, (title, url)


def test_best_link_rules(spark):
    # first of equals
    assert _best(spark, "zzz", ["https://a.example/1", "https://b.example/2"]).url == "https://a.example/1"
    # the position counts absolute links before the block list
    hrefs = ["/rel", "https://twitter.com/x", " https://a.example/p#top "]
    best = _best(spark, "zzz", hrefs)
    assert (best.url, best.score, best.position) == ("https://a.example/p", 50.0, 1)
    # a lone home page stays below the threshold
    assert _best(spark, "zzz", ["https://a.example/"]) is None
    assert _best(spark, "zzz", []) is None
    assert _best(spark, "zzz", ["HTTP://a.example/x", "mailto:x", ""]) is None
    # a bad host is skipped, but has a position
    assert _best(spark, "zzz", ["http://[x/#top", "https://a.example/q#top"]).score == 50.0
    # the exact rule lets a host through that only contains a blocked name
    assert _best(spark, "zzz", ["https://microsoft.com/a"]) is None
    assert _best(spark, "zzz", ["https://microsoft.com/a"], match="exact").score == 0.0
