"""URL rules: host-suffix and path-prefix expressions, equi-joined on short hash prefixes, then confirmed.

A URL is expanded into every (host suffix at a label boundary) x (path prefix ending in "/") expression.  URLs and rules meet on
the first 32 bits of the expression's SHA-256; the full digest and the rule's whole path then confirm, and the longest rule wins.
Distinct pairs of host and directory are expanded, not pages, so a hot site costs one expansion; popular expressions such as a
top-level domain meet their rule in slices.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICES = 16
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` (after the first ``://``, A-Z lowered) and ``path`` (then up to ``?``, ``#`` or the end)."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def directory(path: Column) -> Column:
    """The path up to its last "/"; empty if there is none."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def digests(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def expressions(sites: DataFrame, labels_most: int, depth_most: int) -> DataFrame:
    """``sites`` (host, folder) once per host suffix and path prefix: digest and its first 32 bits.

    Suffixes with more labels and prefixes with more "/" than any rule has fit none, so a URL of any length stays cheap.
    """
    labels = F.split("host", r"\.")
    first = F.greatest(F.lit(1), F.size("labels") - (labels_most - 1))
    suffixes = F.transform(F.sequence(first, F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    parts = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth_most), F.size("parts") - 1)), lambda i: F.concat(F.array_join(F.slice("parts", 1, i), "/"), F.lit("/")))
    out = sites.where("host <> '' AND folder <> ''").withColumn("labels", labels).withColumn("parts", F.split("folder", "/"))
    out = out.withColumn("suffix", F.explode(F.array_distinct(suffixes))).withColumn("prefix", F.explode(parts))
    return out.select("host", "folder", digests(F.col("suffix"), F.col("prefix")).alias("digest")).withColumn("short", F.substring("digest", 1, 8))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``key``, host, path, rule, verdict.

    ``rules`` (host, path, verdict): a host and a path that starts with "/".  A rule fits its host and all subdomains if the
    page's path starts with the rule's.  The longest rule wins, then the longest host; of equal rules the least verdict.  A null
    url or one without ``://`` has empty host and path, fits no rule and gets ``default``.  Rows and keys may repeat or be null.
    """
    seen = host_and_path(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), "url").select("key", "host", "path", directory(F.col("path")).alias("folder"))
    sites = seen.select("host", "folder").distinct()
    rules = rules.where("host IS NOT NULL AND path LIKE '/%'").select("host", "path", "verdict")
    most = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.size(F.split("path", "/")) - 1).alias("depth")).first()
    known = (rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
             .withColumn("rule_digest", digests(F.col("rule_host"), directory(F.col("rule_path"))))
             .withColumn("rule_short", F.substring("rule_digest", 1, 8)).withColumn("rule_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))))
    asked = expressions(sites, most["labels"] or 1, most["depth"] or 1).withColumn("slice", F.pmod(F.xxhash64("host", "folder"), F.lit(SLICES)).cast("int"))
    met = asked.join(known, (asked["short"] == known["rule_short"]) & (asked["slice"] == known["rule_slice"])).where("digest = rule_digest")
    # a rule's path may go on behind its last "/": the rules of a site stay a list until the page's own path decides
    fit = met.groupBy("host", "folder").agg(F.collect_set(F.struct("rule_host", "rule_path", "verdict")).alias("rules")).select(F.col("host").alias("of_host"), F.col("folder").alias("of_folder"), "rules")
    # a directory of a site may hold a third of all pages
    fit = fit.withColumn("of_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    out = seen.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(SLICES)).cast("int"))
    out = out.join(fit, (out["host"] == fit["of_host"]) & (out["folder"] == fit["of_folder"]) & (out["slice"] == fit["of_slice"]), "left")
    ranked = F.transform(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])),
                         lambda r: F.struct((-F.length(r["rule_host"]) - F.length(r["rule_path"])).alias("long"), (-F.length(r["rule_host"])).alias("deep"),
                                            r["verdict"].alias("verdict"), F.concat(r["rule_host"], r["rule_path"]).alias("rule")))
    best = F.array_min(ranked)
    return out.withColumn("best", best).select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT p.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1"""
