import random

from pandas.testing import assert_frame_equal

from pollweave.llm import urls

from .helpers import pandas_pair


def test_query_agrees_with_sql(spark):
    assert_frame_equal(*pandas_pair(spark, "op10_url_filters", "page_id"))


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + (p or "")), len(h), h + (p or ""), v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_rules_against_brute_force_over_many_ranges(spark):
    pick = random.Random(2)
    labels, parts = ["com", "org", "a", "b", "Ab", "", "ä"], ["/", "/a", "/a/b", "/\U0010ffffx", "", "/a\x00b", "/en/1"]
    pages = [(n, f"http{pick.choice(['', 's'])}://{'.'.join(pick.choice(labels) for _ in range(pick.randint(1, 4)))}{pick.choice(parts)}{pick.choice(['', '?q=://x', '#t/'])}") for n in range(400)]
    pages += [(400, None), (401, ""), (402, "no scheme/x"), (402, "no scheme/x"), (None, "x://com/a"), (404, "a://"), (405, "://com/a/b\n"), (406, "u://" + "a." * 300 + "com/" + "z" * 5000)]
    rules = [("com", "/", "block"), ("a.com", "/a", "allow"), ("b", None, "block"), ("b", "/a/b", "allow"), ("com", "/\U0010ffff", "allow"), ("org", "/a\x00", "block"), (None, "/", "block"), ("", "/", "block")]
    frame = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS verdict").repartition(5)
    known = spark.createDataFrame(rules, "host string, path string, verdict string")
    for size in (20, 1_000_000):
        rows = urls.apply_rules(frame, known, keys_per_range=size).collect()
        assert sorted(map(repr, map(tuple, rows))) == sorted(repr((n, *brute(url, rules))) for n, url in pages)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.apply_rules(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urls.apply_rules(one, rules, default="block").first().verdict == "block"
