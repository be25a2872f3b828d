import pytest
from pyspark.sql import functions as F

from opsframe.llm.url_filter import RULES, build_trie, judge, look_up, split_url


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://a.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/9", "x.www.example.com", "/en/9", "www.example.com/en/", "allow"),
    ("https://example.com/en", "example.com", "/en", "com/", "allow"),
    ("https://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
    ("https://b.net/de/1", "b.net", "/de/1", None, "allow"),
    ("https://com", "com", "", None, "allow"),
    ("https://notexample.com?x=/en/", "notexample.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("http://a.com/x://y", "a.com", "/x://y", "com/", "allow"),
    ("http://" + "s." * 4000 + "net/fr/" + "x/" * 5000, "s." * 4000 + "net", "/fr/" + "x/" * 5000, "net/fr/", "block"),
])
def test_verdicts(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(url, 1), (url, 1)], "url string, host long")
    rows = df.select("host", judge(spark, F.col("url"), RULES).alias("j")).select("j.*").collect()
    assert [tuple(r) for r in rows] == [(host, path, rule, verdict)] * 2


def test_trie_against_all_rules():
    rules = [*RULES, ("block", "example.com", "/e"), ("allow", "example.com", "/en/x"), ("allow", "com", "/"), ("block", "com", "/tie"), ("allow", "com", "/tie")]
    trie = build_trie(rules)
    for url in ("http://example.com/ex", "http://example.com/en/xyz", "http://q.com/tie/1", "http://com/a", "http://a.b.net/es/", "http://org/"):
        host, path = split_url(url)
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: (r[1].count("."), len(r[1]), len(r[2]), r[0] == "block"), default=None)
        assert look_up(trie, host, path) == (best and (best[1] + best[2], best[0]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "url string")
    assert df.select(judge(spark, F.col("url"), RULES).alias("j")).count() == 0
