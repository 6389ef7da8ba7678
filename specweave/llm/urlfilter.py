"""URL verdicts: host and path rules, then a list of canonical URLs.

The list goes into a blocked Bloom filter of bounded size that is broadcast;
only urls it lets through reach the exact hash join with the list, which
removes the false positives.  No other url is shuffled.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule and isn't listed; repeated rows are judged one by one; an empty list
blocks nothing; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): rules of the production query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Query parameters that only track where a visitor came from.
TRACKING = r"(?:utm_[^=&]*|gclid|fbclid|ref|sessionid)(?:=[^&]*)?"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return host, path


def canonical(url: str = "url") -> Column:
    """host/path?query without scheme, default port, ``www.``, fragment, index page, trailing slash and tracking parameters; parameters sorted."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(?:80|443)?\z", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"/(?:index\.html?)?\z", "")
    query = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^{TRACKING}$"))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  ``rules`` is a configuration list; the plan holds it."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    tests = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for _, h, p in longest]
    pick = lambda values: F.coalesce(*(F.when(t, F.lit(v)) for t, v in zip(tests, values)), F.lit(None).cast("string"))
    return pick([h + p for _, h, p in longest]), pick([v for v, _, _ in longest])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for each row of ``pages`` (page_id, url).

    ``listed`` (canonical): urls to block.  It may be of any size; the filter made of it isn't.
    """
    keys = listed.select(F.col("canonical").alias("key")).where("key is not null").distinct()
    n = bloom.blocks_for(keys.count())
    host, path = host_and_path()
    own = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), canonical().alias("key"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = own.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "key")
    # written once, without the pages' other columns: both branches read it
    tried = staged(bloom.probe(own, "key", bloom.build(keys, "key", n), n), "tried")
    passed = tried.where("maybe").join(keys.withColumn("listed", F.lit(True)), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    out = tried.where("not maybe").withColumn("listed", F.lit(False)).select("page_id", "host", "path", "rule", "verdict", "listed")
    out = out.unionByName(passed.select(*out.columns))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")))


def sample_list(pages: DataFrame) -> DataFrame:
    """A stand-in for a published block list: the crawl's canonical urls whose MD5 begins with 0."""
    return pages.select(canonical().alias("canonical")).where(F.substring(F.md5("canonical"), 1, 1) == "0").distinct()


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, staged(sample_list(pages), "url-list"))


OP3_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)\z', 1) AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(?:80|443)?\z', ''), '^www\.', '') AS ch,
             regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/(?:index\.html?)?\z', '') AS cp,
             array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
               lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(?:utm_[^=&]*|gclid|fbclid|ref|sessionid)(?:=[^&]*)?$'))), '&') AS q FROM h),
k AS (SELECT *, CASE WHEN ch <> '' THEN ch || cp || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM c),
l AS (SELECT DISTINCT canonical FROM k WHERE substr(md5(canonical), 1, 1) = '0'),
r(v, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT page_id, host, path,
       (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS rule,
       coalesce((SELECT v FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1),
                CASE WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(canonical IN (SELECT canonical FROM l), false) AS listed
FROM k
"""
