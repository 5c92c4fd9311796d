"""Filter URLs by host and path rules and by a list of canonical URLs.

A blocked Bloom filter of the list, a table with one 512-bit row per block, is asked
first: a URL's hash names one block and a few bits in it. Only possible hits go to
an exact join with the list, which removes the false positives. Both joins see
distinct canonical URLs, so a URL that a third of all pages carry is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsift.llm import common

#: host, path, verdict
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Words in a host's labels that put a page's URL on the list of the query.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
WORDS_PER_BLOCK = 8
BITS_PER_KEY = 12
PROBES = 6


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(common.lower_ascii(after), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Without scheme, query, fragment, www. or m., .html and closing slashes."""
    short = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.concat(short, F.regexp_replace(path, r"(\.html?)?/*$", ""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest rule that fits and its verdict, or nulls. Rules are a parameter."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("int")


def _bits(key: Column) -> Column:
    """PROBES bit numbers in a block, from two hashes."""
    a, b = F.pmod(F.hash(key), F.lit(512)), F.pmod(F.hash(key, F.lit(1)), F.lit(256)) * 2 + 1
    return F.array(*[((a + b * i) % 512).cast("int") for i in range(PROBES)])


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(url) -> a row per block that holds any bit: block, words."""
    bits = listed.select(_block(F.col("url"), blocks).alias("block"), F.explode(_bits(F.col("url"))).alias("bit"))
    words = [
        F.bit_or(
            F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, cast(bit % 64 as int))"))
            .otherwise(F.lit(0).cast("bigint"))
        )
        for w in range(WORDS_PER_BLOCK)
    ]
    return bits.groupBy("block").agg(F.array(*words).alias("words"))


def on_list(keys: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """Rows of keys (url, distinct) that are in listed (url): filter, then exact join."""
    asked = keys.withColumn("block", _block(F.col("url"), blocks)).withColumn("bits", _bits(F.col("url")))
    possible = asked.join(bloom(listed, blocks), "block").filter(
        F.expr("forall(bits, b -> (shiftright(words[cast(b div 64 as int)], cast(b % 64 as int)) & 1L) = 1L)")
    )
    return possible.select("url").join(listed, "url", "left_semi")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int | None = None) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, listed, verdict.

    A rule's verdict comes first; without one a listed canonical URL is blocked and
    any other allowed. A null url, or one without ://, has an empty host and path,
    fits no rule, isn't listed and is allowed. Repeated rows are judged alike; an
    empty list blocks nothing. Other columns of pages are dropped.
    """
    listed = listed.select("url").filter("url is not null and url <> ''").distinct()
    if blocks is None:
        blocks = max(1, -(-listed.count() * BITS_PER_KEY // 512))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "key", canonical(F.col("host"), F.col("path"))
    )
    hits = on_list(parsed.select(F.col("key").alias("url")).distinct(), listed, blocks)
    rule, by_rule = rule_for(F.col("host"), F.col("path"), rules)
    return (
        parsed.join(hits.select(F.col("url").alias("key"), F.lit(True).alias("hit")), "key", "left")
        .select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"), F.col("hit").isNotNull().alias("listed"))
        .withColumn("verdict", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")))
        .drop("by_rule")
    )


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of pages on hosts that carry one of LISTED_LABELS."""
    pages = common.table(spark, sf_dir, "pages")
    host = host_of(F.col("url"))
    listed = pages.filter(host.rlike(r"(^|\.)(" + "|".join(LISTED_LABELS) + r")\.")).select(
        canonical(host, path_of(F.col("url"))).alias("url")
    )
    return judge(pages, listed)


SQL_URLS = r"""
with cut as (
  select page_id, url, strpos(url, '://') as pos from pages),
rest as (select page_id, case when pos > 0 then substr(url, pos + 3) else '' end as r, coalesce(pos, 0) > 0 as ok from cut),
parsed as (
  select page_id,
    case when ok then translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when ok then regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) else '' end as path from rest),
keyed as (
  select *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html?)?/*$', '') as key from parsed),
listed as (select distinct key from keyed
  where regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.') and key <> ''),
rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
ruled as (
  select k.page_id, k.host, k.path, k.key,
    (select max_by(h || p, length(h || p)) from rules
      where (k.host = h or ends_with(k.host, '.' || h)) and starts_with(k.path, p)) as rule,
    (select max_by(v, length(h || p)) from rules
      where (k.host = h or ends_with(k.host, '.' || h)) and starts_with(k.path, p)) as v
  from keyed k)
select page_id, host, path, rule, key in (select key from listed) as listed,
  coalesce(v, case when key in (select key from listed) then 'block' else 'allow' end) as verdict from ruled
"""

QUERIES = {"op4_url_filter": op4_url_filter}
SQL = {"op4_url_filter": SQL_URLS}
