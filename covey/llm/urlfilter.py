"""URL filters as a sort-merge range join over reversed-host canonical keys, in DataFrame operations alone.

A rule (host, path) fits a url whose host is the rule's or a subdomain of it and whose path starts with the rule's.
For each suffix of a url's host there is a canonical key: the suffix's labels reversed, then the path.  In the order
of these keys everything that a rule fits is one interval, [rule key, rule key + largest character], and intervals of
two rules nest or are disjoint.  Rules and keys are merged in one sorted sweep: at each key the last rule that has
begun carries the stack of the rules that enclose it, and the innermost of the stack whose interval still holds the
key is the longest rule for that suffix.  The longest over the suffixes wins.

Scale: a host has as many suffixes to look at as a rule's host has labels at most, so keys grow with the length of a
host, never its square.  Only suffixes that are some rule's host take part (an equi-join with the rules' hosts).  The sweep is split by
(suffix, salt), so a suffix that holds a third of all urls is swept by as many tasks as there are salts; rules are
copied to the salts of their own suffix alone.  Equal urls of a page are judged once.  No html is read.

Judgements: the longest rule is that of the most characters in host and path; between equal lengths the longer host,
then block.  Without a rule the verdict is DEFAULT.  A null url or one without :// has an empty host and path and no
rule; so has an empty host.  Repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covey.llm.common import bounded_partitions

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(suffix, key, stack): for each different rule the rules of its host that enclose it, itself included."""
    one = rules.select(F.translate("host", _UPPER, _LOWER).alias("suffix"), F.col("path").alias("key"), "verdict").where("suffix is not null and key is not null").groupBy("suffix", "key").agg(F.max("verdict").alias("verdict"))
    begun = one.withColumn("begin", F.explode(F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))))
    outer = one.select("suffix", F.col("key").alias("begin"), F.struct(F.length("key").alias("length"), F.col("key").alias("key"), "verdict").alias("rule"))
    return begun.join(outer, ["suffix", "begin"]).groupBy("suffix", "key").agg(F.collect_list("rule").alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, salts: int | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict), a row for each row of ``pages`` (page_id, url and any others)."""
    salts = salts or bounded_partitions(pages.sparkSession)
    urls = pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("times"))
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    dots = F.length("host") - F.length(F.replace(F.col("host"), F.lit(".")))
    most = rules.agg(F.max(F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))))).first()[0] or 0
    every = F.transform(F.sequence(F.lit(1), F.least(dots, F.lit(most)) + 1), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    stacks = rule_stacks(rules)
    hosts = stacks.select("suffix").distinct()
    keys = urls.select("page_id", "url", "path", F.explode(every).alias("suffix")).where("suffix <> ''").join(hosts, "suffix")
    keys = keys.select("suffix", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"), F.col("path").alias("key"), F.lit(1).alias("turn"), "page_id", "url", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    begins = stacks.select("suffix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", F.lit(0).alias("turn"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("url"), "stack")
    # the sweep: a rule comes before the keys equal to it; the last rule begun brings the stack of those around it
    sweep = Window.partitionBy("suffix", "salt").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = begins.unionByName(keys).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("turn = 1")
    held = F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]))
    inner = F.array_max(held)
    # ordered by: characters of host and path, characters of the host, block before allow
    best = swept.withColumn("in", inner).where("in is not null").select("page_id", "url", F.struct((F.length("suffix") + F.col("in.length")).alias("length"), F.length("suffix").alias("host_length"), F.col("in.verdict").alias("verdict"), F.concat("suffix", F.col("in.key")).alias("rule")).alias("best"), F.lit(0).cast("long").alias("times"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    every_url = urls.select("page_id", "url", F.lit(None).cast(best.schema["best"].dataType).alias("best"), "times", "host", "path")
    out = every_url.unionByName(best).groupBy("page_id", "url").agg(F.max("best").alias("best"), F.max("times").alias("times"), F.max("host").alias("host"), F.max("path").alias("path"))
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
with r(host, path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u as (select row_number() over () n, page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path from pages),
m as (select n, max(struct_pack(a := length(r.host || r.path), b := length(r.host), verdict := r.verdict, rule := r.host || r.path)) best
  from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) group by n)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') verdict from u left join m using (n)
"""
