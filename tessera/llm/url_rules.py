"""URL rules by a sort-merge range join of reversed-host keys.

A host's canonical key is its labels in reverse, each followed by a dot
("net.example.blog."), so a rule's host and all its subdomains are the interval
of keys from the rule's key up to that key with a slash for its last dot.  Such
intervals nest or are disjoint.  The sweep goes over boundaries and hosts in key
order; what is carried along is the stack of rules active since the last
boundary.  At the rows of a url the stack's rules whose path starts the url's
path are compared, and the longest (host and path together, then host; block
before allow for a rule given twice) decides.

The sweep is dealt out by salt, not by key: every salt has all boundaries and an
even share of the urls, so no host, however frequent, meets in one task.  The
number of salts is held down so that boundaries times salts stay within
COPIES rows.

A null url, and one without "://", has empty host and path, which fit no rule.
A repeated row is judged as often as it occurs.  No rules: all get the default.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import read

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Rows of boundaries over all salts, at most; but LEAST salts in any case.
COPIES, LEAST = 50_000_000, 32


def lowered(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    kind = "array<struct<host:string,path:string,verdict:string>>"
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def boundaries(rules: DataFrame) -> DataFrame:
    """key, stack: the rules active from that key on."""
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.col("verdict"), F.concat("host", "path").alias("rule"), F.col("path"))
    at = rules.dropna().withColumn("host", lowered(F.col("host"))).groupBy(canonical(F.col("host")).alias("at")).agg(F.sort_array(F.collect_set(rule)).alias("own"))
    labels = F.split(F.expr("substring(at, 1, length(at) - 1)"), r"\.")
    above = at.select("at", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("over"))
    chain = above.join(at.select(F.col("at").alias("over"), "own"), "over").groupBy("at").agg(F.flatten(F.collect_list("own")).alias("start"), F.flatten(F.collect_list(F.when(F.col("over") != F.col("at"), F.col("own")))).alias("end"))
    edges = F.array(F.struct(F.col("at").alias("key"), F.col("start").alias("stack")), F.struct(F.expr("concat(substring(at, 1, length(at) - 1), '/')").alias("key"), F.col("end").alias("stack")))
    return chain.select(F.inline(edges))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for page_id, url."""
    spark = urls.sparkSession
    host, path = host_and_path(F.col("url"))
    salts = max(LEAST, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), COPIES // max(1, 2 * rules.count())))
    edges = boundaries(rules).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "key", "stack", F.lit(0).alias("kind"))
    swept = urls.select("page_id", host.alias("host"), path.alias("path"))
    swept = swept.select(F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("salt"), canonical(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path")
    order = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.last("stack", ignorenulls=True).over(order)
    both = edges.unionByName(swept, allowMissingColumns=True).withColumn("stack", active).where("kind = 1")
    best = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])))
    return both.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, RULES))


ORACLE = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
fit AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM h JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT h.page_id, h.host, h.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM h LEFT JOIN fit ON h.page_id = fit.page_id
"""
