"""URL filtering by host and path rules, with digests instead of long strings in the join.

A url is expanded into expressions: every host suffix (whole labels) with every path prefix
that ends in a slash, and with no path at all. A rule is stored under one expression: its
host and its path up to the last slash. Urls and rules meet in an equi-join on the first
characters of the expressions' SHA-256; the full digest and the rest of the rule's path are
compared afterwards, then the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.llm.registry import query, table
from corepart.store import Store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8  # hexadecimal digits of a digest in the join
SLOT_ROWS = 1_000_000  # rows of one url that go to one task
OFTEN = 10_000  # urls that may be broadcast with their number of slots, the most frequent ones
BROADCAST_RULES = 50_000  # rule rows that may be broadcast: some megabytes


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, ASCII lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty when there is no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _rule_index(rules: DataFrame) -> DataFrame:
    """One row per rule: its short and full digest, and what decides precedence."""
    host = F.translate(F.coalesce(F.col("host"), F.lit("")), UPPER, LOWER)
    path = F.coalesce(F.col("path"), F.lit(""))
    cut = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    out = rules.where(F.col("verdict").isNotNull() & (host != "")).select(
        host.alias("r_host"),
        path.alias("r_path"),
        F.sha2(F.concat(host, cut), 256).alias("r_full"),
        F.concat(host, path).alias("rule"),
        F.col("verdict"),
    )
    return out.select(F.substring("r_full", 1, SHORT).alias("short"), "*").distinct()


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(row, host, path, rule, verdict): one row per row of `pages`, which is kept whole in `row`.

    `rules` has (host, path, verdict). A rule fits its host and all subdomains when the url's
    path starts with the rule's path. The longest rule (host and path together) wins; equal
    lengths: the longer host, then the greater verdict (block over allow), then the greater
    string. Nothing fits: rule null and the default verdict. A null url and one without `://`
    have empty host and path and fit no rule. Rules without host or verdict are ignored; a
    null path is an empty one. Repeated pages give repeated rows.
    """
    index = _rule_index(rules)
    most = index.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max(_labels(F.col("r_host"))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(_slashes(F.col("r_path"))), F.lit(0)).alias("slashes"),
    ).first()
    if most.n <= BROADCAST_RULES:
        index = F.broadcast(index)
    rows = pages.select(
        F.struct("*").alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    # No rule has more labels or slashes than these, so longer expressions fit none.
    labels = F.least(_labels(F.col("host")), F.lit(most.labels))
    slashes = F.least(_slashes(F.col("path")), F.lit(most.slashes))
    named = rows.where(F.col("host") != "")
    urls = named.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    expressions = (
        urls
        .withColumn("i", F.explode(F.sequence(F.lit(1), labels)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), slashes)))
        .select(
            "host",
            "path",
            "n",
            F.sha2(
                F.concat(
                    F.expr("substring_index(host, '.', -i)"),
                    F.when(F.col("j") > 0, F.expr("concat(substring_index(path, '/', j), '/')")).otherwise(""),
                ),
                256,
            ).alias("full"),
        )
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    best = (
        expressions.join(index, "short")
        .where((F.col("full") == F.col("r_full")) & F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule"), F.length("r_host"), "verdict", "rule")).alias("best"), F.max("n").alias("n"))
    )
    # Urls without a host can match nothing and meet no key. The rows of a url that comes often are
    # dealt to slots, and its verdict is copied to each.
    store = Store(pages.sparkSession, "url-rules")
    best = store.save(best.withColumn("fan", F.ceil(F.col("n") / slot_rows).cast("int")).drop("n"), "best")
    often = best.where("fan > 1").orderBy(F.desc("fan"), "host", "path").limit(OFTEN).select("host", "path", F.col("fan").alias("f"))
    named = named.join(F.broadcast(often), ["host", "path"], "left")
    named = named.withColumn("slot", F.floor(F.rand(1) * F.coalesce("f", F.lit(1))).cast("int")).drop("f")
    verdicts = best.join(F.broadcast(often), ["host", "path"], "left")
    verdicts = verdicts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("f", F.lit(1)) - 1))).drop("f", "fan")
    judged = named.join(verdicts, ["host", "path", "slot"], "left").drop("slot")
    nameless = rows.where(F.col("host") == "").withColumn("best", F.lit(None).cast(verdicts.schema["best"].dataType))
    return judged.unionByName(nameless).select(
        "row",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


# Fixed values of the query: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query(
    "op6_url_rules",
    f"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(v, h, s) AS (VALUES {", ".join(map(str, RULES))}),
m AS (
  SELECT p.*, v, h || s AS rule,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
""",
)
def op6_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = table(spark, sf, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("row.page_id", "host", "path", "rule", "verdict")
