"""URL rules by hashed host-suffix and path-prefix expressions.

A rule (host, path, verdict) fits its host and all subdomains where the URL's
path starts with the rule's. Each URL is expanded into the expressions that a
rule could be stored under, the expressions meet the rules by the first eight
hex digits of their SHA-256, the whole digests confirm, and the longest rule
wins (block before allow among equally long ones).

Expansion follows the rules, not a cap: only as many host labels as the longest
rule host has, and only prefixes as long as some rule path, since no other
expression can equal a rule's. The rules' label count and path lengths are all
that reaches the driver; path lengths are bounded by the longest rule path.

Null, or no "://": host and path are empty and no rule fits. Equal URLs get
equal rows; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaspark.llm.common import ascii_lower, table

# The production rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT_VERDICT = "allow"
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every concatenation of a host suffix of at most `labels` labels and a path prefix of one of `lengths`."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.concat_ws(".", F.slice(parts, F.size(parts) - n + 1, n)),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]),
        lambda p: p.isNotNull(),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per page: key, host, path, rule, verdict."""
    rules = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict").where("verdict is not null")
    stats = rules.agg(F.max(F.size(F.split("h", r"\.", -1))), F.collect_set(F.length("p"))).first()
    labels, lengths = stats[0] or 1, sorted(stats[1])
    digest = F.sha2(F.concat("h", "p"), 256)
    rules = rules.select(F.substring(digest, 1, PREFIX_HEX).alias("prefix"), digest.alias("digest"), F.concat("h", "p").alias("rule"), "verdict")

    # A page without URL gets a key of its own, so that such pages don't meet in one task.
    pages = pages.select(F.col(key).alias("id"), F.coalesce(F.col(url), F.concat(F.lit("null:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("u"))
    wide = pages.select("u").where(F.col("u").contains("://")).select("u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    hashed = wide.select("u", F.explode(expressions(F.col("h"), F.col("p"), labels, lengths)).alias("e")).select("u", F.sha2("e", 256).alias("own"))
    best = (
        hashed.withColumn("prefix", F.substring("own", 1, PREFIX_HEX))
        .join(rules, "prefix")
        .where("own = digest")
        .groupBy("u")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best"))
    )
    return pages.join(best, "u", "left").select(
        F.col("id").alias(key),
        host_of(F.col("u")).alias("host"),
        path_of(F.col("u")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = """
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut)
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts
"""
