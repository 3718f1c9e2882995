"""robots.txt, policy and site-text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import lines
from weftline.functions.urls import authority


def sitemap_lines(body: Column) -> Column:
    """Distinct sitemap addresses in their order."""
    return F.array_distinct(F.filter(F.transform(lines(body), lambda x: F.trim(F.regexp_extract(x, r"(?i)^\s*sitemap:(.*)$", 1))), lambda x: x != ""))


def _tagged(robots: DataFrame) -> DataFrame:
    """authority, line_no, key, value of every rule line (comments cut off)."""
    x = robots.filter("body is not null").select("authority", F.posexplode(lines(F.col("body"))).alias("line_no", "line"))
    x = x.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    return x.select("authority", "line_no", F.lower(F.trim(F.regexp_extract("line", r"^([^:]+):", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)).alias("value")).filter("key <> ''")


def crawl_delays(robots: DataFrame, agent: str = "*") -> DataFrame:
    """authority, delay of an agent: the first delay under its own name, else the last one under '*'; only numeric ones.

    Every user-agent line starts anew, so in a group of several names only the last one has the rules.
    """
    w = Window.partitionBy("authority").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    t = _tagged(robots).withColumn("agent", F.last(F.when(F.col("key") == "user-agent", F.lower("value")), ignorenulls=True).over(w))
    d = t.filter("key = 'crawl-delay'").withColumn("delay", F.expr("try_cast(value as double)")).filter("delay is not null")
    own = F.min_by("delay", F.when(F.col("agent") == agent.lower(), F.col("line_no")))
    wild = F.max_by("delay", F.when(F.col("agent") == "*", F.col("line_no")))
    return d.groupBy("authority").agg(F.coalesce(own, wild).alias("delay")).filter("delay is not null")


def rules(robots: DataFrame) -> DataFrame:
    """authority, rule_no, agents (array), path, allow: one row per allow or disallow line of a group."""
    w = Window.partitionBy("authority").orderBy("line_no")
    t = _tagged(robots)
    before = F.lag("key").over(w)
    t = t.withColumn("new", ((F.col("key") == "user-agent") & (F.coalesce(before, F.lit("")) != "user-agent")).cast("int"))
    t = t.withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = t.filter("key = 'user-agent'").groupBy("authority", "grp").agg(F.collect_list(F.lower("value")).alias("agents"))
    lines_ = t.filter("key in ('allow', 'disallow')").select("authority", "grp", F.col("line_no").alias("rule_no"), F.col("value").alias("path"), (F.col("key") == "allow").alias("allow"))
    return lines_.join(agents, ["authority", "grp"]).drop("grp")


def allowed(urls: DataFrame, rule_rows: DataFrame, agent: str) -> DataFrame:
    """urls (with a column url) and allowed: the first matching rule in file order decides, of the agent's own group if it
    has one, else of '*'; no rule allows. An empty disallow allows everything."""
    u = urls.withColumn("__a", authority(F.col("url"))).withColumn("__p", F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")))
    own = F.exists("agents", lambda a: (a != "*") & (a != "") & F.contains(F.lit(agent.lower()), a))
    r = rule_rows.withColumn("__own", own).filter(F.col("__own") | F.array_contains("agents", "*"))
    best = r.groupBy("authority").agg(F.max("__own").alias("__any"))
    r = r.join(best, "authority").filter(F.col("__own") == F.col("__any")).groupBy("authority").agg(F.array_sort(F.collect_list(F.struct("rule_no", "path", "allow"))).alias("__rules"))
    hit = F.filter("__rules", lambda x: (x["path"] == "") | F.col("__p").startswith(x["path"]))
    first = F.try_element_at(hit, F.lit(1))
    return u.join(r, u["__a"] == r["authority"], "left").select(*urls.columns, F.coalesce(first["allow"] | (first["path"] == ""), F.lit(True)).alias("allowed"))


# What robots files, terms and home pages say of permission, and how feeds, map entries and terms are written.
_FORBIDS, _GRANTS, _FORBIDS_SCRAPING, _OFFERS = r"(?i)disallow:\s*/", r"(?i)creative\s+commons", r"(?i)scrap|no scraping", "(?i)api"
_FEED = r"(?i)<link[^>]+type=[\"']application/rss\+xml[\"'][^>]+href=[\"']([^\"']+)[\"']"
_LOC, _TERMS = "<loc>([^<]+)</loc>", r"(?i)href=[\"']([^\"']*(?:terms|tos)[^\"']*)[\"']"


def permission(robots: Column, home: Column, tos: Column, feeds: Column, prior: Column) -> Column:
    """Class of a site: red if robots forbids anything or the terms forbid scraping, green if they grant Creative Commons, or if the
    class is still yellow and the home page names an interface or a feed a free licence; else what it was, yellow at first."""
    before = F.lower(F.coalesce(prior, F.lit("yellow")))
    first = F.when(robots.rlike(_FORBIDS), "red").otherwise(before)
    second = F.when(tos.rlike(_GRANTS), "green").when(tos.rlike(_FORBIDS_SCRAPING), "red").otherwise(first)
    free = F.coalesce(home.rlike(_OFFERS), F.lit(False)) | F.coalesce(F.exists(feeds, lambda f: F.contains(F.lower(f), F.lit("creativecommons"))), F.lit(False))
    return F.when((second == "yellow") & free, "green").otherwise(second)


def rss_links(home: Column) -> Column:
    return F.regexp_extract_all(home, F.lit(_FEED), F.lit(1))


def sitemap_locs(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(_LOC), F.lit(1))


def terms_link(home: Column, base: Column) -> Column:
    """Address of the terms of service: the first link that names terms or tos."""
    href = F.nullif(F.regexp_extract(home, _TERMS, 1), F.lit(""))
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(href, F.lit("/"))))
