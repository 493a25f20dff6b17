"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (host, path, verdict) of the dealt query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, lower-cased; path: then up to ? or #. Both are empty where there is no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _digests(expression: str) -> list[Column]:
    digest = F.sha2(expression, 256)
    return [digest.alias("digest"), F.substring(digest, 1, 8).alias("short")]


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of pages.

    rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with
    the rule's; of several the longest text host + path wins, then the longer host, then block. No rule:
    null and `default`. Each distinct host and path is expanded into the host suffixes and path
    prefixes whose number of labels and length some rule has; SHA-256 digests meet the rules' by their first 32 bits, full
    digests confirm. Rules with a null host or path fit nothing. Null urls have an empty host and path. Rows that
    repeat an id or a url are judged each. A very long url costs as many prefixes as rules have lengths. Empty tables of
    pages give empty ones, those of rules the default for all. Other columns of pages aren't looked at.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.select(ascii_lower("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").where("rule_host is not null and rule_path is not null")
    rules = rules.withColumn("rule", F.concat("rule_host", "rule_path"))
    # the lengths of paths in rules: a few numbers, however many rules there are
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    labels = F.split("host", r"\.")
    # so many labels as some rule's host has: a few numbers too, so a host of many dots isn't cut at each
    depths = sorted(r[0] for r in rules.select(F.size(F.split("rule_host", r"\."))).distinct().collect())
    wanted = F.filter(F.array(*[F.lit(n) for n in depths]).cast("array<int>"), lambda n: n <= F.size(labels))
    suffixes = F.transform(wanted, lambda n: F.array_join(F.slice(labels, -n, n), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(prefixes, lambda n: F.substr(F.col("path"), F.lit(1), n))
    asked = rows.select("host", "path").distinct()
    asked = asked.select("host", "path", F.explode(suffixes).alias("on_host"), prefixes.alias("p")).select("host", "path", "on_host", F.explode("p").alias("on_path"))
    asked = asked.withColumn("expression", F.concat("on_host", "on_path")).select("host", "path", "on_host", *_digests("expression"))
    listed = rules.select("rule", "rule_host", "verdict", *_digests("rule"))
    hits = asked.join(listed.withColumnRenamed("digest", "full"), "short").where("digest = full and on_host = rule_host")
    rank = F.struct(F.length("rule"), F.length("rule_host"), F.col("verdict") == "block", "rule", "verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    # urls that no rule fits, many of them alike, needn't meet: rules hit few distinct hosts and paths, and adaptive execution splits those that many pages share
    found = rows.join(best, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url by the five dealt rules."""
    rules = spark.sql("select * from values " + ", ".join(str(r) for r in RULES) + " as t(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP4_SQL = f"""
with rules(rule_host, rule_path, verdict) as (values {", ".join(str(r) for r in RULES)}),
cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
best as (select host, path, max(struct_pack(n := length(rule_host || rule_path), h := length(rule_host), b := verdict = 'block', rule := rule_host || rule_path, verdict := verdict)) as best
    from (select distinct host, path from parts) u join rules on (host = rule_host or host like '%.' || rule_host) and starts_with(path, rule_path)
    group by host, path)
select page_id, parts.host, parts.path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict
from parts left join best on parts.host = best.host and parts.path = best.path
"""
