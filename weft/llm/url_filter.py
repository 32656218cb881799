"""URL filters by a temporal list join.

A list entry says from which day on a key (a host, a domain above it, or a host with a path before) is blocked or allowed. A
key's entries become validity intervals, each until the next. A capture meets the interval of each of its keys that holds
on its day: an as-of join, made an equal join by splitting time into periods of PERIOD days: an interval is written for each
period that it touches, a capture has one. So a key with many captures spreads over periods; the captures of a hot key (a
top-level domain, say) are dealt further, and its few intervals go to each part. The longest key that has an active entry decides.

Defined results: entries that repeat count once; of entries of one key and day, block wins. A null or malformed url has no
keys, is not blocked, and its host is empty. A null day meets nothing. Captures that repeat are returned each. Without
entries nothing is blocked. Entries with a null key, day or action are left out. Empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, read

PERIOD = 64
#: A key is hot if it is at least one in HOT_KEYS of all captures' keys, and HOT_ROWS of them.
HOT_ROWS, HOT_KEYS, SALTS = 10_000, 1000, 32
#: Day after all days.
NEVER = 1 << 30
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def keys(url):
    """The host, every domain above it, and the host with every whole beginning of the path."""
    labels, steps = F.split(host(url), r"\."), F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    paths = F.transform(F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(host(url), F.lit("/"), F.concat_ws("/", F.slice(steps, F.lit(1), i))))
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """key, begin, end (the first day on which it holds no more), action."""
    e = entries.select(F.col("key").cast("string").alias("key"), F.col("day").cast("int").alias("begin"), F.col("action").cast("string").alias("action")).na.drop()
    e = e.groupBy("key", "begin").agg(F.max("action").alias("action"))  # "block" is after "allow"
    return e.withColumn("end", F.coalesce(F.lead("begin").over(Window.partitionBy("key").orderBy("begin")), F.lit(NEVER)))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: id, url, day. Each with its host, the deciding entry (key, since, action), and whether it is blocked."""
    captures = captures.select("id", "url", F.col("day").cast("int").alias("day"))
    span = captures.agg(F.min("day").alias("first"), F.max("day").alias("last")).head()
    first, last = (span["first"] or 0), (span["last"] or 0)
    held = intervals(entries).where((F.col("begin") <= last) & (F.col("end") > first))
    period = lambda c: F.floor(c / PERIOD).cast("int")
    held = held.withColumn("period", F.explode(F.sequence(period(F.greatest("begin", F.lit(first))), period(F.least(F.col("end") - 1, F.lit(last))))))
    asked = captures.distinct().withColumn("key", F.explode(keys(F.col("url")))).withColumn("period", period(F.col("day")))
    hot = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT_ROWS, -(-(hot.agg(F.sum("n")).head()[0] or 0) // HOT_KEYS))
    hot = [r["key"] for r in hot.where(F.col("n") >= least).select("key").collect()]
    # A hot key's captures are dealt among SALTS, each of which gets its intervals: such keys are HOT_KEYS at most.
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    asked = asked.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).otherwise(0))
    held = held.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    met = asked.join(held.hint("merge"), ["key", "period", "salt"]).where((F.col("begin") <= F.col("day")) & (F.col("day") < F.col("end")))
    deciding = met.groupBy("id", "url", "day").agg(F.max(F.struct(F.length("key").alias("size"), "key", "begin", "action")).alias("x"))
    deciding = deciding.select(F.col("id").alias("_id"), F.col("url").alias("_url"), F.col("day").alias("_day"), "x.key", F.col("x.begin").alias("since"), "x.action")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("url") == F.col("_url")) & (F.col("day") == F.col("_day"))
    out = captures.join(deciding.hint("merge"), same, "left")
    return out.select("id", "url", "day", host(F.col("url")).alias("host"), "key", "since", "action", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"))


def number(text, salt: str, below: int):
    """A number from 0 to below - 1 by a text's hash: the same in SQL."""
    return (F.conv(F.substring(F.md5(F.concat(text, F.lit(salt))), 1, 7), 16, 10).cast("bigint") % below).cast("int")


DAYS = 1461


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have neither days nor a list, so both are made from hashes: a capture's day from its page_id, and up to three
    entries (block, allow, block) for one in four of the keys that occur."""
    pages = read(spark, sf_dir, "pages")
    id_, url = column(pages, "page_id", "bigint"), column(pages, "url", "string")
    captures = pages.select(id_.alias("id"), url.alias("url"), number(F.coalesce(id_.cast("string"), F.lit("")), "@", DAYS).alias("day"))
    listed = captures.select(F.explode(keys(F.col("url"))).alias("key")).distinct().where(number(F.col("key"), "?", 4) == 0)
    made = [F.struct(number(F.col("key"), f"#{k}", DAYS).alias("day"), F.lit(a).alias("action")) for k, a in enumerate(("block", "allow", "block"))]
    entries = listed.select("key", F.explode(F.slice(F.array(*made), F.lit(1), number(F.col("key"), "!", 3) + 1)).alias("x")).select("key", "x.day", "x.action")
    return filter_captures(captures, entries).withColumnRenamed("id", "page_id").withColumnRenamed("day", "fetched_day")


ORACLE = r"""
WITH c AS (
  SELECT page_id, url, CAST(CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || '@'), 1, 7) AS BIGINT) % 1461 AS INTEGER) AS fetched_day,
    lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS steps FROM pages),
d AS (SELECT *, string_split(host, '.') AS labels FROM c),
k AS (
  SELECT page_id, url, fetched_day, array_to_string(labels[i:], '.') AS key FROM d, range(1, 100) r(i) WHERE host <> '' AND i <= len(labels)
  UNION SELECT page_id, url, fetched_day, host || '/' || array_to_string(steps[1:i], '/') FROM d, range(1, 100) r(i) WHERE host <> '' AND i <= len(steps)),
l AS (SELECT DISTINCT key FROM k WHERE CAST('0x' || substr(md5(key || '?'), 1, 7) AS BIGINT) % 4 = 0),
e AS (
  SELECT key, CAST(CAST('0x' || substr(md5(key || '#' || CAST(n AS VARCHAR)), 1, 7) AS BIGINT) % 1461 AS INTEGER) AS since, max(CASE n WHEN 1 THEN 'allow' ELSE 'block' END) AS action
  FROM l, range(0, 3) r(n) WHERE n <= CAST('0x' || substr(md5(key || '!'), 1, 7) AS BIGINT) % 3 GROUP BY 1, 2),
v AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM e),
m AS (
  SELECT k.page_id, k.url, k.fetched_day, v.key, v.since, v.action,
    row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched_day ORDER BY length(v.key) DESC, v.key DESC) AS n
  FROM k JOIN v ON k.key = v.key AND v.since <= k.fetched_day AND (v.until IS NULL OR k.fetched_day < v.until))
SELECT d.page_id, d.url, d.fetched_day, d.host, m.key, m.since, m.action, coalesce(m.action = 'block', FALSE) AS blocked
FROM d LEFT JOIN m ON d.page_id IS NOT DISTINCT FROM m.page_id AND d.url = m.url AND m.n = 1
"""
