"""URL filters: host-suffix and path-prefix expressions matched by short hash prefixes, then by full digests.

DataFrame functions only. Every URL is expanded into just those (labels of the host's end, characters of the
path's start) shapes that some rule has, so the expansion is complete and stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace
from .workspace import fields, table

#: The rules of the contract: (verdict, host, path), fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Hexadecimal digits of a digest that serve as join key.
PREFIX_DIGITS = 8

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(verdict, host, path) rows as digests. Of equal rules the blocking one counts; nulls make no rule."""
    clean = rules.select("verdict", "host", "path").dropna()
    kept = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    return kept.select(
        rule.alias("rule"),
        "verdict",
        F.length(rule).alias("rule_length"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_length"),
        F.sha2(rule, 256).alias("digest"),
    ).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))


def judge_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: key, host, path, rule (null if none fits) and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's path; the longest fitting rule
    decides, else ``default``. A null url, or one without ``://``, has an empty host and path. Repeated pages are
    judged one by one; an empty table gives an empty result. Matching needs one shuffle of at most one row per page,
    since the best match of a page is found before it leaves its task when the rules are broadcast.
    """
    ready = prepare_rules(rules)
    shapes = sorted((r[0], r[1]) for r in ready.select("labels", "path_length").distinct().collect())
    rows = fields(pages, key=key, url=url).select(
        F.monotonically_increasing_id().alias("row"), "key", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    if not shapes:
        return rows.select(F.col("key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # one literal array of shapes, so that the plan doesn't grow with the rules
    known = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in shapes])

    def expression(shape: Column) -> Column:
        end = F.array_join(F.slice("labels", -shape["n"], shape["n"]), ".")
        fits = (F.size("labels") >= shape["n"]) & (F.length("path") >= shape["m"])
        return F.when(fits, F.concat(end, F.substr("path", F.lit(1), shape["m"])))

    rows = rows.withColumn("labels", F.split("host", r"\."))
    found = F.explode_outer(F.array_compact(F.transform(known, expression)))
    expanded = rows.select("row", "key", "host", "path", found.alias("expression"))
    expanded = expanded.withColumn("full", F.sha2("expression", 256)).withColumn(
        "prefix", F.substring("full", 1, PREFIX_DIGITS)
    )
    side = ready.select("prefix", "digest", "rule", "rule_length", "verdict")
    if workspace.small(side):
        side = F.broadcast(side)
    matched = expanded.join(side, "prefix", "left")
    sure = F.col("full") == F.col("digest")
    best = F.max(F.when(sure, F.struct("rule_length", "rule", "verdict"))).alias("best")
    return (
        matched.groupBy("row", "key", "host", "path")
        .agg(best)
        .select(
            F.col("key").alias(key),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        )
    )


def write_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), write_rules(spark, RULES))


OP8_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN contains(url, '://')
  THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row, page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
fits AS (SELECT p.*, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.row
  ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k FROM parts p LEFT JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
