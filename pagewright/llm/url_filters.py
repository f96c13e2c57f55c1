"""URL rules, and block decisions that travel along redirects and canonical links.

A rule is a host and a path prefix; it fits its host and all subdomains, and the longest rule that fits decides. Urls
without a rule take the decision of their aliases: a url and its canonical spelling are one node, redirects and
canonical links are edges, and a component with a blocked url is blocked as a whole. An explicit allow rule of a url
always comes before what its aliases say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of one generated expression; more are joined by host.
INLINE_RULES = 500
#: Query parameters that name where a visitor came from.
TRACKING = r"(?:utm_[a-z]*|ref|fbclid|gclid)"


def host_of(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The spelling that aliases share: no scheme, no www. or m., no fragment, no tracking parameters, no last slash."""
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, rf"([?&]){TRACKING}=[^&]*", "$1"), r"&+", "&")
    query = F.regexp_replace(F.regexp_replace(query, r"^\?&", "?"), r"[?&]$", "")
    host = F.regexp_replace(host_of(url), r"^(?:www\.|m\.)", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.regexp_replace(path_of(url), r"/$", ""), query))


def links_in(html: Column) -> Column:
    """Targets of canonical links and of refreshing meta tags, as an array; null html has none."""
    tag = lambda name, has: F.filter(F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\s[^>]*>"), F.lit(0)), lambda t: t.rlike(has))
    href = F.transform(tag("link", r"""(?i)rel\s*=\s*["']?canonical"""), lambda t: F.regexp_extract(t, r"""(?i)href\s*=\s*["']?([^"'\s>]+)""", 1))
    fresh = F.transform(tag("meta", r"""(?i)http-equiv\s*=\s*["']?refresh"""), lambda t: F.regexp_extract(t, r"""(?i)url\s*=\s*['"]?([^"'\s>]+)""", 1))
    return F.filter(F.coalesce(F.concat(href, fresh), F.array().cast("array<string>")), lambda u: F.instr(u, "://") > 0)


def _fitting(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls with rule and ruled (its verdict), both null where none fits."""
    rules = sorted({(v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules}, key=lambda r: (-len(r[1] + r[2]), r))
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
    if len(rules) <= INLINE_RULES:
        found = F.coalesce(
            *[
                F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("ruled")))
                for v, h, p in rules
            ]
        )
        return urls.withColumn("found", found).withColumns({"rule": F.col("found.rule"), "ruled": F.col("found.ruled")}).drop("found")
    spark = urls.sparkSession
    table = spark.createDataFrame(rules, "ruled string, h string, p string").groupBy("h").agg(F.collect_list(F.struct((-F.length(F.concat("h", "p"))).alias("n"), "ruled", F.col("h").alias("of"), "p", F.concat("h", "p").alias("rule"))).alias("rs"))
    hosts = urls.select("host").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    of_host = hosts.select("host", F.explode(suffix).alias("h")).join(table, "h").groupBy("host").agg(F.flatten(F.collect_list("rs")).alias("rs"))
    # the longest first; ties as in the sorted rules: allow before block, then host and path
    best = F.array_min(F.filter("rs", lambda r: F.col("path").startswith(r["p"])))
    return urls.join(of_host, "host", "left").withColumn("found", best).withColumns({"rule": F.col("found.rule"), "ruled": F.col("found.ruled")}).drop("found", "rs")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Rows (id, host, path, rule, verdict, because), one for each row of pages.

    rules are (allow or block, host, path prefix); of equally long rules that fit, allow comes before block, and then the
    smaller host and path. Repeated rows and long urls are judged like all others. redirects has columns from_url and to_url; canonical links and
    refreshes inside html_col are edges as well. because is rule, alias or default. A null url has an empty host and
    path, no rule and no aliases, and is allowed. Components grow in the shared folder (see connected_components); the
    blocked ones are joined by key, which adaptive execution splits where one is hot.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "urls")
    url = F.col(url_col)
    html = links_in(F.col(html_col)) if html_col else F.array().cast("array<string>")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"), html.alias("links"))
    rows = ws.table(_fitting(rows, rules))
    edges = rows.where(F.size("links") > 0).select(F.col("key").alias("a"), F.explode("links").alias("to")).select("a", canonical(F.col("to")).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(canonical(F.col("from_url")).alias("a"), canonical(F.col("to_url")).alias("b")))
    components = connected_components(spark, edges, ws)
    # a key without an edge is its own component
    blocked = rows.where("ruled = 'block' and key is not null").select("key").distinct()
    bad = blocked.join(components.withColumnRenamed("node", "key"), "key", "left").select(F.coalesce("component", "key").alias("component")).distinct()
    more = components.join(bad, "component").select(F.col("node").alias("key"))
    bad_keys = blocked.unionByName(more).distinct().withColumn("alias", F.lit(True))
    ruled = rows.where("rule is not null").withColumn("alias", F.lit(False))
    rest = rows.where("rule is null").join(bad_keys, "key", "left").select(*ruled.columns)
    verdict = F.when(F.col("rule").isNotNull(), F.col("ruled")).when(F.col("alias"), "block").otherwise("allow")
    because = F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias"), "alias").otherwise("default")
    return ruled.unionByName(rest).select("id", "host", "path", "rule", verdict.alias("verdict"), because.alias("because"))
