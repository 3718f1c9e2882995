"""Queue, source, registry and log operators: filters, joins, windows and top-k over items, pages and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.urls import authority, is_excluded, is_web_link, link_score, resolve

# What pages say that refuse a visitor.
BLOCK_WORDS = "captcha|are you a robot|access denied|verify you are human|to continue please|too many requests"
#: The address of an anchor, in double or single quotes or in none.
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


# -- filters -----------------------------------------------------------------------------------------------------------


def recent(when: Column, now: Column, days: int = 2) -> Column:
    """Within the last days, bounds included; undated items stay."""
    return when.isNull() | (when >= now - F.make_dt_interval(F.lit(days)))


def recent_strict(when: Column, now: Column, hours: int = 24) -> Column:
    """Within the last hours; undated items go."""
    return F.coalesce(when >= now - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(False))


def sufficient(title: Column, text: Column) -> Column:
    return (F.coalesce(title, F.lit("")) != "") & (F.coalesce(text, F.lit("")) != "")


def rate_limited(status: Column, snippet: Column) -> Column:
    return F.coalesce(status.isin(429, 503), F.lit(False)) | F.coalesce(F.lower(snippet).rlike(BLOCK_WORDS), F.lit(False))


def changed(old: Column, new: Column) -> Column:
    return ~old.eqNullSafe(new)


def is_page_type(content_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.split(content_type, ";")[0])).isin("text/html", "text/plain", "application/xhtml+xml"), F.lit(False))


def needs_analysis(pending: Column, selectors: Column) -> Column:
    """Whether a source's structure has yet to be analysed: it is marked so, or has no selectors and no mark."""
    return F.coalesce(pending, selectors.isNull() | (F.size(selectors) == 0))


def needs_crawl(rss_feed: Column) -> Column:
    return F.coalesce(F.trim(rss_feed), F.lit("")) == ""


def old_selectors(selectors: Column) -> Column:
    """Whether the selector map is of the older form; with its own key it can say that it is not."""
    keys = F.map_keys(selectors)
    return F.coalesce(F.exists(keys, lambda k: k.endswith("_selector")) & ~F.array_contains(keys, "_is_json_css_schema"), F.lit(False))


def backoff(delay: Column, times: Column) -> Column:
    """The delay doubled so many times, at most 300 s."""
    return F.least(delay * F.pow(F.lit(2.0), F.least(times, F.lit(60))), F.lit(300.0))


# -- queue -------------------------------------------------------------------------------------------------------------


def union_producers(*producers: DataFrame) -> DataFrame:
    """The items of all producers with their rank, columns aligned by name."""
    out = None
    for i, p in enumerate(producers):
        p = p.withColumn("producer", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def seen_key(link: Column, ident: Column) -> Column:
    return F.coalesce(F.nullif(link, F.lit("")), F.nullif(ident, F.lit("")))


def first_wins(items: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first item of each key in the order given; items without a key are not valid and go.

    An aggregate of the least row, not a window: partial results are merged before the shuffle, so no key is a hot spot.
    """
    rest = [c for c in items.columns if c not in order]
    best = items.withColumn("__key", key).filter(F.col("__key").isNotNull()).groupBy("__key").agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return best.select(*[F.col("__first")[c].alias(c) for c in items.columns])


def first_n(items: DataFrame, order: list[str], n: int = 1000) -> DataFrame:
    """The first n rows in that order, as a bounded result keeps them."""
    return items.orderBy(*order).limit(n)


def last_n(log: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last n rows in that order (a bounded sort, nothing is collected)."""
    return log.orderBy(*[c.desc() for c in order]).limit(n)


# -- joins -------------------------------------------------------------------------------------------------------------


def with_source(items: DataFrame, sources: DataFrame, limit: int = 100_000) -> DataFrame:
    """Items with the settings of their source by name (first by base_url if given twice); a miss gives null settings."""
    one = sources.groupBy(F.col("name").alias("source_name")).agg(F.min(F.struct("base_url", "parser_config_name", "rss_feed")).alias("s")).select("source_name", F.col("s.base_url").alias("base_url"), F.col("s.parser_config_name").alias("parser_config_name"))
    if sources.limit(limit + 1).count() <= limit:
        one = F.broadcast(one)
    return items.join(one, "source_name", "left")


def migrate_sources(sources: DataFrame) -> DataFrame:
    """The current form of the configuration: the legacy parser key moves, missing flags take their defaults."""
    name = F.coalesce("parser_config_name", "parser_config")
    pending = needs_analysis(F.col("llm_analysis_pending"), F.col("extraction_selectors"))
    return sources.withColumn("parser_config_name", name).withColumn("llm_analysis_pending", pending).drop("parser_config")


def entry_urls(base: Column, sections: Column) -> Column:
    """Base and section addresses, distinct, in their order."""
    urls = F.coalesce(F.transform(sections, lambda s: s["url"]), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(base), urls), lambda u: u.isNotNull()))


def new_domains(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """domain, feeds: domains of mentions(link, feed) that no known(base_url) has, with the feeds that name them, sorted."""
    m = mentions.withColumn("domain", authority(F.col("link"))).filter("domain is not null").groupBy("domain").agg(F.array_sort(F.collect_set("feed")).alias("feeds"))
    k = known.select(F.lower(authority(F.col("base_url"))).alias("__d")).filter("__d is not null").distinct()
    return m.join(k, F.lower("domain") == F.col("__d"), "left_anti")


def merge_right_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with the columns of their right row; shared columns take the right value where there is a right row."""
    r = right.select(F.col(key), F.struct(*[c for c in right.columns if c != key]).alias("__r"))
    j = left.join(r, key, "left")
    shared = set(right.columns) - {key}
    own = [F.when(F.col("__r").isNotNull(), F.col("__r")[c]).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns]
    return j.select(*own, *[F.col("__r")[c].alias(c) for c in right.columns if c not in left.columns])


def upsert(registry: DataFrame, updates: DataFrame, key: str = "domain") -> DataFrame:
    """The registry with the rows of updates in place of its own; both have one row per key (see last_wins)."""
    return registry.join(updates.select(key), key, "left_anti").unionByName(updates)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("__l")).select(*[F.col(key) if c == key else F.col("__l")[c].alias(c) for c in rows.columns])


# -- links -------------------------------------------------------------------------------------------------------------


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url: the distinct absolute links of each page that no pattern excludes, worked out within the row.

    Anchors may quote their address either way or not at all; references of any kind are resolved against the page's address. A
    page row that is given twice gives its links twice.
    """
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    bare = F.transform(found, lambda h: F.replace(F.regexp_replace(h, r"^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")))
    screened = F.transform(F.array_distinct(bare), lambda h: F.struct(h.alias("href"), resolve(F.col("base"), F.trim(h)).alias("url")))
    kept = F.filter(screened, lambda x: is_web_link(x["href"], x["url"]) & ~is_excluded(x["url"]))
    p = pages.filter("html is not null").select("page_id", "html", F.col("url").alias("base"))
    return p.select("page_id", F.explode(F.array_distinct(F.transform(kept, lambda x: x["url"]))).alias("url"))


def first_links(links: DataFrame, n: int = 10) -> DataFrame:
    """The first n links of each page in the order of their addresses, for want of a score."""
    w = Window.partitionBy("page_id").orderBy("url")
    return links.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_links(links: DataFrame, n: int = 10, threshold: float | None = None) -> DataFrame:
    """The n best links of each page by score, ties by address."""
    s = links.withColumn("score", link_score(F.col("url")))
    if threshold is not None:
        s = s.filter(F.col("score") >= threshold)
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "url")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# -- log ---------------------------------------------------------------------------------------------------------------


def log_entry(ts: Column, kind: Column, message: Column, details: Column) -> Column:
    return F.struct(ts.alias("ts"), F.upper(kind).alias("type"), message.alias("message"), details.alias("details"))


def encode(value: Column) -> Column:
    """JSON of a struct, map or array, null fields kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def failure(component: Column, message: Column, url: Column, details: Column) -> Column:
    """Message and details of an error entry; component and url go into the details."""
    return F.struct(F.lit("ERROR").alias("type"), message.alias("message"), F.map_concat(F.coalesce(details, F.create_map().cast("map<string,string>")), F.map_from_arrays(F.array(F.lit("component"), F.lit("url")), F.array(component, url))).alias("details"))


def changes_over_time(pages: DataFrame, key: str, when: list[str], indicator: Column) -> DataFrame:
    """Every page with its indicator and whether it differs from the one before of the same key (null for the first)."""
    w = Window.partitionBy(key).orderBy(*when)
    return pages.withColumn("indicator", indicator).withColumn("before", F.lag("indicator").over(w)).withColumn("changed", F.when(F.row_number().over(w) > 1, changed(F.col("before"), F.col("indicator"))))
