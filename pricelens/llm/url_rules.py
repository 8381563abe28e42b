"""URL filters: host-suffix and path-prefix expressions against a rule table.

Each URL is expanded into one expression per host suffix and rule-path length, joined to
the rules on a 32-bit hash prefix, confirmed on the full digest, and judged by the longest
rule. Only distinct URLs are expanded, and no more than one row per URL comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..tables import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast (a few MB); more are joined by shuffle.
BROADCAST_RULES = 50_000
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``action`` (allow or block), ``host`` and ``path``. A rule fits its host and
    all subdomains when the URL's path starts with the rule's path. Of the rules that fit, the
    longest ``host + path`` wins, then the longer host; of rules stated twice, a block wins.
    Without a rule ``rule`` is null and the verdict is ``default``. Columns of ``urls`` keep
    their values unless they have one of the four names, which are replaced. A null or
    malformed URL has an empty host and path and meets no rule with a host. Rules with a null
    part are dropped; an empty table of rules leaves the default for all. Repeated rows stay.
    """
    rules = rules.select("action", F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).dropna()
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    rule = F.concat("rule_host", "rule_path")
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    rules = rules.withColumn("digest", digest(F.col("rule_host"), F.col("rule_path"))).select(F.substring("digest", 1, 8).alias("short"), "digest", "action", rule.alias("rule"), F.length("rule_host").alias("host_length"))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    lengths = [r[0] for r in rules.select(F.length("rule") - F.col("host_length")).distinct().collect()]  # no more than the longest path has characters

    distinct = urls.select(F.col(url).alias("_url")).distinct().select("_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    expanded = (
        distinct.select("_url", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix"))
        .select("_url", "path", "suffix", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("length"))
        .where(F.col("length") <= F.length("path"))
        .withColumn("full", digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("length"))))
        .select("_url", F.substring("full", 1, 8).alias("short"), "full")
    )
    hit = expanded.join(F.broadcast(rules) if few else rules, "short").where(F.col("full") == F.col("digest"))
    best = hit.groupBy("_url").agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", "rule", "action")).alias("_best"))
    kept = urls.drop("host", "path", "rule", "verdict")
    return kept.join(best, kept[url] == best["_url"], "left").select(
        *(kept[c] for c in kept.columns), host_of(kept[url]).alias("host"), path_of(kept[url]).alias("path"), F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict")
    )


def op8_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH rules(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (
  SELECT p.page_id, p.host, p.path, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, max_by(r.action, length(r.rhost || r.rpath)) AS action
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM best
"""
