"""URL filter in DataFrame functions only: host and path rules, then a blocked Bloom filter before an exact join.

The filter of listed canonical URLs is a table of blocks of eight 64-bit words. A URL's hash picks its block
and one bit in each word, so a probe touches one row. URLs that pass may be listed; only these go to an
exact join with the list, which removes the false positives. The filter is broadcast while it has at most
BROADCAST_BLOCKS blocks (72 bytes each); beyond that it is joined by a shuffle on the block.

Defined cases: null urls and urls without "://" have empty host and path, fit no rule and are never listed;
repeated urls are judged alike; null and repeated entries of the list don't matter.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (host, path start, verdict) fixed by the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
BITS_PER_URL = 16
BROADCAST_BLOCKS = 1 << 17
#: The list of the registered query: each host with each language and every STEP-th number below UP_TO.
LISTED_HOSTS = ("ads-track.example.com", "ads-track.example.org", "tionsh.example.com", "tionsh.example.org", "therha.example.com", "theror.example.org")
LISTED_LANGUAGES, STEP, UP_TO = ("en", "es", "de", "fr"), 3, 60_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without a closing slash or .html, query without campaign parameters; no fragment, no scheme. Null without "://"."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/|\.html)$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(?:^|&)(?:utm_[^&]*|ref=[^&]*)", ""), r"^&", "")
    return F.when(url.contains("://"), F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rules else (F.lit(None).cast("string"),) * 2


def _masks(key: Column) -> list[Column]:
    """One bit for each word of the block."""
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0 to w7) of all keys; partial bit_or before the shuffle."""
    rows = keys.select(_block(F.col(key), n_blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def url_filter(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", listed_url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page; the list blocks what no rule decides."""
    names = listed.select(canonical(F.col(listed_url).cast("string")).alias("_name")).filter(F.col("_name").isNotNull()).distinct()
    n_blocks = max(names.count() * BITS_PER_URL // (64 * WORDS), 1)
    blocks = bloom_blocks(names, "_name", n_blocks)
    if n_blocks <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    u = F.col(url).cast("string")
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("_name"))
    probed = rows.withColumn("block", _block(F.coalesce("_name", F.lit("")), n_blocks)).join(blocks, "block", "left")
    held = [F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(F.coalesce("_name", F.lit(""))))]
    may = F.col("_name").isNotNull() & F.coalesce(held[0] & held[1] & held[2] & held[3] & held[4] & held[5] & held[6] & held[7], F.lit(False))
    probed = probed.select("page_id", "host", "path", "_name", may.alias("_may"))
    hits = probed.filter("_may").join(names.withColumn("_in", F.lit(True)), "_name", "left").select("page_id", "host", "path", F.coalesce("_in", F.lit(False)).alias("listed"))
    rest = probed.filter(~F.col("_may")).select("page_id", "host", "path", F.lit(False).alias("listed"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))
    return hits.unionByName(rest).select("page_id", "host", "path", rule.alias("rule"), judged.alias("verdict"), "listed")


def registered_list(spark: SparkSession) -> DataFrame:
    """The list of the registered query, made by a rule and independent of the pages judged: 480,000 URLs in a feed's spelling."""
    numbers = spark.range(0, UP_TO, STEP).select("id", F.explode(F.array(*map(F.lit, LISTED_HOSTS))).alias("host"))
    each = numbers.select("id", "host", F.explode(F.array(*map(F.lit, LISTED_LANGUAGES))).alias("lang"))
    return each.select(F.concat(F.lit("https://www."), "host", F.lit("/"), "lang", F.lit("/"), F.col("id").cast("string"), F.lit("/?utm_medium=feed")).alias("url"))


ORACLE = r"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS name
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^&]*|ref=[^&]*)', '', 'g'), '^&', '') AS q FROM p)),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  coalesce(name IN (SELECT h || '/' || l || '/' || i FROM (SELECT unnest(['ads-track.example.com', 'ads-track.example.org', 'tionsh.example.com', 'tionsh.example.org', 'therha.example.com', 'theror.example.org']) AS h),
    (SELECT unnest(['en', 'es', 'de', 'fr']) AS l), (SELECT unnest(range(0, 60000, 3)) AS i)), false) AS listed FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""
