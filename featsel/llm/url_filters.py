"""URL allow and block rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.llm.common import small, table, written

# The rules of the registered query (host followed by a path prefix, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Verdict on a url that no rule fits.
DEFAULT = "allow"
#: Hexadecimal digits of the hash prefixes (32 bits).
PREFIX = 8


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule, verdict) rows as a DataFrame."""
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in r)) for r in rules)
    return spark.sql(f"select * from values {quoted} as t(rule, verdict)")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a url; both empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """`pages` (with column url) plus host, path, rule, verdict.

    A rule is a host and a path prefix, `host/path`; it fits its host and all subdomains when the
    url's path starts with the rule's. The longest fitting rule wins (then the one that sorts
    last; of two verdicts on one rule, block); without one the verdict is `default`.

    Every distinct (host, path) is expanded into those host suffixes whose number of labels, and those path prefixes whose
    length, some rule has; so a host of very many labels makes no more of them than there are such numbers. Expressions
    meet the rules by an equi-join on the first 32 bits of their
    SHA-256; full digests then confirm. Expansion is done on distinct (host, path) pairs, so a url
    that many rows share is judged once, and on no text but the url. What was found is written before it is joined with
    the pages, so that Spark can split a url that many of these share.

    A null url, or one without ://, has an empty host and path and fits no rule. Rows are returned
    as often as they come, with their other columns; columns named host, path, rule or verdict are
    replaced; null and malformed rules (no /) are ignored; empty tables give no rows or no fits."""
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = url_parts(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path})

    rules = rules.where("rule like '%/%' and verdict is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    slash = F.instr("rule", "/")
    rules = rules.withColumn("digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))
    # the lengths of rule paths: as many as the longest path has characters, at the most
    lengths = sorted(r[0] for r in rules.select((F.length("rule") - slash + 1).alias("n")).distinct().collect())
    # the numbers of labels of rule hosts: as many as the longest host has labels, at the most
    of_host = F.size(F.split(F.substring(F.col("rule"), F.lit(1), slash - 1), r"\."))
    counts = sorted(r[0] for r in rules.select(of_host.alias("n")).distinct().collect())

    # of a host of fewer labels this is the whole host, which may come up again
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in counts]).cast("array<string>"))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    seen = pages.where("host <> ''").select("host", "path").distinct()
    each = seen.withColumn("suffix", F.explode(suffixes)).withColumn("n", F.explode(fitting))
    each = each.select("host", "path", F.expr("concat(suffix, substring(path, 1, n))").alias("expression"))
    each = each.withColumn("full", F.sha2("expression", 256)).withColumn("prefix", F.substring("full", 1, PREFIX))
    fits = each.join(rules, "prefix").where("full = digest")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    best = small(written(best.select("host", "path", "best.rule", "best.verdict")), most_bytes=16_777_216)
    out = pages.join(best, ["host", "path"], "left")
    return out.select(*pages.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_table(spark)).drop("url")


ORACLE_SQL = """
with parts as (
  select page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(rule, verdict) as (
  values ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')
), fits as (
  select s.page_id, s.host, s.path, r.rule, r.verdict from split s left join rules r
    on ('.' || s.host) like ('%.' || split_part(r.rule, '/', 1))
   and starts_with(s.path, substr(r.rule, instr(r.rule, '/')))
)
select page_id, host, path, arg_max(rule, length(rule)) as rule, coalesce(arg_max(verdict, length(rule)), 'allow') as verdict
from fits group by page_id, host, path
"""
