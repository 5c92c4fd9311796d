"""URL rules, the list, and the filter in front of it."""

from idsift.llm import urls
from pyspark.sql import functions as F

URLS = [
    None, "", "no scheme", "http://", "http:///path", "HTTP://A.Example.ORG/es/x?q#f", "https://example.org/en/123",
    "https://notexample.org/en/1", "http://x.com/fr/1", "http://com/fr/", "http://x.com/de", "http://x.com/de/",
    "http://www.spam.net/a.html", "https://m.spam.net/a/", "http://spam.net/a?x=1", "http://spam.net/b", "a://b://c/d",
    "http://x.org", "http://x.org?y/", "http://Ünicode.org/ä", "http://x.net/" + "p" * 100_000, "http://spam.net/b",
]


def expected(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        cut = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
        path = path[:cut]
    fit = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    if best:
        return host, path, best[0] + best[1], best[2]
    short = host.removeprefix("www.") if host.startswith("www.") else host.removeprefix("m.")
    tail = path.rstrip("/")
    tail = tail.removesuffix(".html") if tail.endswith(".html") else tail
    return host, path, None, "block" if short + tail in listed else "allow"


def test_against_plain_code(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, key string")
    names = ["spam.net/a", "spam.net/b", "other.net"]
    listed = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "url string")
    for blocks in (None, 1):
        found = {r["page_id"]: r for r in urls.judge(pages, listed, blocks=blocks).collect()}
        assert len(found) == len(URLS)
        for i, u in enumerate(URLS):
            r = found[i]
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(u, names), u
    none = urls.judge(pages, listed.limit(0))
    assert none.filter("verdict = 'block' and rule is null").count() == 0
    assert urls.judge(pages.limit(0), listed).count() == 0


def test_filter_loses_nothing_and_lets_little_through(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("url"))
    listed = keys.filter("substring(url, 2) % 4 = 0")
    blocks = 5_000 * urls.BITS_PER_KEY // 512
    asked = keys.withColumn("block", urls._block(F.col("url"), blocks)).withColumn("bits", urls._bits(F.col("url")))
    possible = asked.join(urls.bloom(listed, blocks), "block").filter(
        F.expr("forall(bits, b -> (shiftright(words[cast(b div 64 as int)], cast(b % 64 as int)) & 1L) = 1L)")
    )
    assert possible.join(listed, "url", "left_semi").count() == 5_000
    assert possible.count() < 5_000 + 15_000 * 0.05
    assert urls.on_list(keys, listed, blocks).count() == 5_000
