"""URL filters (operator 2): decisions travel over redirect and canonical-link edges. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from indoorspark.llm.common import components, stored, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
AFTER = r"(?s)^.*?://"
ALIAS_HOST = r"^(www|m|mobile|amp)\."
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid)="


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def exact_address(url: Column) -> Column:
    """Host, path and query; null if there is no host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def implied_address(url: Column) -> Column:
    """Where sites redirect their own variants: no www. or m., no tracking parameter, no closing slash or .html."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1), F.lit(""))
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?i)(/index)?\.html?$", ""), "/+$", "")
    host = F.regexp_replace(host_of(url), ALIAS_HOST, "")
    return F.when(host_of(url) != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def stated_targets(url: Column, html: Column) -> Column:
    """Targets of <link rel=canonical> and <meta http-equiv=refresh> in the page, as array of urls."""
    canonical = F.regexp_extract_all(html, F.lit(r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    refresh = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    full = lambda t: F.when(t.contains("://"), t).when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.startswith("/"), F.concat(base, t))
    return F.transform(F.concat(F.coalesce(canonical, F.array()), F.coalesce(refresh, F.array())), full)


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and alias_of for every page.

    A fitting rule decides its page. A page without one is blocked if an alias (its component over
    redirect, canonical and implied-redirect edges) is blocked and none is explicitly allowed; else
    allowed. Null urls, or urls without host: no rule, no alias, allowed. Null html: no stated edges.
    Repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
    """
    url, host, path = F.col("url"), host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(host, path, rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("ruled"), exact_address(url).alias("address"), implied_address(url).alias("implied"), stated_targets(url, F.col("html")).alias("stated"))
    rows = stored(rows, "url-pages")
    stated = rows.where(F.size("stated") > 0).select(F.col("address").alias("a"), F.explode("stated").alias("u"))
    edges = rows.select(F.col("address").alias("a"), F.col("implied").alias("b"))
    edges = edges.unionByName(stated.select("a", exact_address(F.col("u")).alias("b"))).unionByName(stated.select(exact_address(F.col("u")).alias("a"), implied_address(F.col("u")).alias("b")))
    roots = components(edges, "url-edges").withColumnRenamed("node", "address")
    known = rows.where("address is not null").groupBy("address").agg(F.max(F.col("ruled") == "block").alias("blocked"), F.max(F.col("ruled") == "allow").alias("allowed"))
    known = known.join(roots, "address", "left").withColumn("root", F.coalesce("root", "address"))
    known = stored(known, "url-known")
    groups = known.groupBy("root").agg(F.max("blocked").alias("_blocked"), F.max("allowed").alias("_allowed"))
    spread = known.join(groups, "root").select("address", "root", (F.coalesce("_blocked", F.lit(False)) & ~F.coalesce("_allowed", F.lit(False))).alias("_spread"))
    final = F.coalesce("ruled", F.when(F.col("_spread"), "block").otherwise("allow"))
    return rows.join(spread, "address", "left").select("page_id", "host", "path", "rule", final.alias("verdict"), F.col("root").alias("alias_of"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
