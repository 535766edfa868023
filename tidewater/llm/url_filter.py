"""URL filtering by host-suffix / path-prefix rules (native DataFrame operations only).

Every distinct URL is expanded into those host suffixes and path prefixes that have a length of some rule: hosts
by their number of labels, paths by their number of characters. The expansions meet the rules in an equi-join on the first
four bytes of their SHA-256; the full digest then confirms the match, and precedence picks one rule per URL.
So a URL of thousands of labels or characters has no more expansions than the rules have different pairs of lengths, and
none that is longer than it. A rule table's pairs of lengths are a table too, of any size: broadcast while it is small,
else joined by the number of labels.

Defined results: a null URL, or one without ``://``, has empty host and path and fits no rule.
Repeated URLs are judged once and joined back, so repeated rows and null or repeated ids
are kept as they are. An empty table gives an empty result; an empty rule table gives every URL
the default verdict. Only the url column (and those kept) is read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Rule tables up to so many rows are broadcast; beyond it the join shuffles.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"(?s)^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def _prepared(rules: DataFrame) -> DataFrame:
    """rule, verdict, key and digest. Of equal rules a block is kept."""
    rule = F.concat("host", "path")
    return (
        rules.where("host is not null and path is not null")
        .select(rule.alias("rule"), F.length(rule).alias("rule_len"), F.length("host").alias("host_len"), F.length("path").alias("path_len"), _labels("host").alias("labels"), "verdict", F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"))
        .groupBy("rule", "rule_len", "host_len", "path_len", "labels", "digest")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", F.substring("digest", 1, 8))
    )


def _with_shapes(urls: DataFrame, shapes: DataFrame, small: bool) -> DataFrame:
    """Every URL with the pairs of lengths (labels of the host, characters of the path) that it is long enough for."""
    if small:  # as one array of at most BROADCAST_RULES numbers: labels in the high half, characters in the low one
        packed = sorted((r["labels"] << 32) + r["path_len"] for r in shapes.collect())
        every = F.split(F.lit(",".join(map(str, packed))), ",").cast("array<bigint>") if packed else F.array().cast("array<bigint>")
        labels, size = lambda s: F.shiftright(s, 32), lambda s: s.bitwiseAND(F.lit((1 << 32) - 1))
        fit = F.filter(every, lambda s: (labels(s) <= F.col("deep")) & (size(s) <= F.length("p")))
        shaped = urls.withColumn("shape", F.explode(fit))
        return shaped.select("__url", "h", "p", labels(F.col("shape")).cast("int").alias("labels"), size(F.col("shape")).cast("int").alias("path_len"))
    most = shapes.agg(F.max("labels")).scalar()
    tried = urls.withColumn("labels", F.explode(F.sequence(F.lit(1), F.least("deep", most))))
    return tried.join(shapes, "labels").where(F.col("path_len") <= F.length("p"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """keep, host, path, rule and verdict of every row.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest
    rule wins; of two equally long, the one with the longer host. No rule: ``default``.
    """
    rules = _prepared(rules)
    shapes = rules.select("labels", "path_len").distinct()
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    rules = F.broadcast(rules) if small else rules
    base = pages.select(*keep, F.col(url).alias("__url"))
    urls = base.where("__url is not null").select("__url").distinct().select("__url", host_of(F.col("__url")).alias("h"), path_of(F.col("__url")).alias("p"))
    fits = _with_shapes(urls.where("h <> ''").withColumn("deep", _labels("h")), shapes, small)
    suffix = F.expr("substring_index(h, '.', -labels)")
    expanded = (
        fits.select("__url", F.sha2(F.concat_ws("\n", suffix, F.substring(F.col("p"), F.lit(1), F.col("path_len"))), 256).alias("full"))
        .withColumn("key", F.substring("full", 1, 8))
    )
    best = (
        expanded.join(rules, "key")
        .where("full = digest")
        .groupBy("__url")
        .agg(F.max(F.struct("rule_len", "host_len", "rule", "verdict")).alias("best"))
        .select("__url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return base.join(best, "__url", "left").select(*keep, host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS a FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT *,
    CASE WHEN host = 'www.example.com' OR host LIKE '%.www.example.com' THEN 1 ELSE 0 END AS w,
    CASE WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 1 ELSE 0 END AS e,
    CASE WHEN host = 'com' OR host LIKE '%.com' THEN 1 ELSE 0 END AS c,
    CASE WHEN host = 'net' OR host LIKE '%.net' THEN 1 ELSE 0 END AS n
  FROM s
), r AS (
  SELECT page_id, host, path, CASE
    WHEN w = 1 AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN e = 1 AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN n = 1 AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN n = 1 AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN c = 1 AND starts_with(path, '/') THEN 'com/' END AS rule FROM m
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
