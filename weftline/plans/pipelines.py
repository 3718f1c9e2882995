"""The whole flows: discovery, queue processing, seed pages, chunk jobs, policy scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import robots as rb
from weftline.functions import text as tx
from weftline.functions.timestamps import with_instant
from weftline.functions.urls import authority
from weftline.operators import extract, flow
from weftline.operators import markdown as md
from weftline.session import through_table
from weftline.sources import readers as rd


def discover_feeds(sources: DataFrame, homes: DataFrame) -> DataFrame:
    """Sources with rss_feed filled from their home page (url, html) where it was missing; the first link counts."""
    h = homes.select(F.col("url").alias("base_url"), F.try_element_at(extract.feed_links(F.col("html"), F.col("url")), F.lit(1)).alias("__f")).groupBy("base_url").agg(F.min("__f").alias("__f"))
    return sources.join(h, "base_url", "left").withColumn("rss_feed", F.when(flow.needs_crawl(F.col("rss_feed")), F.col("__f")).otherwise(F.col("rss_feed"))).drop("__f")


def selectors(sources: DataFrame, limit: int = 100_000) -> DataFrame:
    """source_name, selectors of every source that has any (the least by their entries, if it is given twice)."""
    entries = F.array_sort(F.map_entries("extraction_selectors"))
    one = sources.filter("name is not null and size(extraction_selectors) > 0").groupBy(F.col("name").alias("source_name")).agg(F.map_from_entries(F.min(entries)).alias("selectors"))
    return F.broadcast(one) if sources.limit(limit + 1).count() <= limit else one


def process_queue(items: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Queue items joined with their source and page, their articles extracted with the selectors of the item's source and
    kept if sufficient; the article's fields win. A page is read once for each source that queued it."""
    q = flow.with_source(items, sources)
    asked = items.select("link", "source_name").distinct().join(selectors(sources), "source_name", "left")
    p = pages.select("page_id", F.col("url").alias("link"), "html").join(asked, "link").withColumn("page_id", F.struct("page_id", "link", "source_name"))
    a = extract.cascade(p, "selectors").select("page_id.link", F.col("page_id.source_name").alias("__source"), "article")
    a = a.groupBy("link", "__source").agg(F.min("article").alias("article")).withColumnRenamed("link", "__link")
    j = q.join(a, (F.col("link") == F.col("__link")) & F.col("source_name").eqNullSafe(F.col("__source"))).drop("__link", "__source").filter(flow.sufficient(F.col("article.title"), F.col("article.text")))
    return j.withColumn("title", F.col("article.title")).withColumn("text", F.col("article.text")).withColumn("extraction_method", F.col("article.method")).drop("article")


def seed_pages(seeds: DataFrame, pages: DataFrame, robots: DataFrame, sources: DataFrame, agent: str = "*", n: int = 10, threshold: float | None = None) -> DataFrame:
    """Articles behind the best links of seed pages: robots, links, score and top-n come before any page is read, with the
    selectors of its source. Where pages have metadata, only those of a readable content type are read."""
    rules = rb.rules(robots)
    start = rb.allowed(seeds, rules, agent).filter("allowed").select("url")
    links = flow.top_links(rb.allowed(flow.page_links(pages.join(start, "url", "left_semi")), rules, agent).filter("allowed").drop("allowed"), n, threshold)
    hit = pages.join(links.select("url").distinct(), "url", "left_semi")
    if "metadata" in pages.columns:
        hit = hit.filter(flow.is_page_type(F.col("metadata")["content_type"]))
    a = extract.cascade(hit.join(selectors(sources), "source_name", "left"), "selectors")
    return a.filter(flow.sufficient(F.col("article.title"), F.col("article.text")))


def scan_policies(domains: DataFrame) -> DataFrame:
    """domain, permission, feed_urls of (domain, robots, sitemap, home, tos, prior): one projection, no shuffle."""
    none = F.array().cast("array<string>")
    feeds = F.array_distinct(F.concat(F.coalesce(rb.sitemap_locs(F.col("sitemap")), none), F.coalesce(rb.rss_links(F.col("home")), none)))
    return domains.select("domain", rb.permission(F.col("robots"), F.col("home"), F.col("tos"), feeds, F.col("prior")).alias("permission"), feeds.alias("feed_urls"))


def update_source(sources: DataFrame, name: str, **values: Column) -> DataFrame:
    """The sources with columns of one of them replaced."""
    return sources.select(*[F.when(F.col("name") == name, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in sources.columns])


def prime_domains(sources: DataFrame, delays: DataFrame, default: float = 1.0) -> DataFrame:
    """name, authority, delay of every source."""
    s = sources.select("name", authority(F.col("base_url")).alias("authority"))
    return s.join(delays, "authority", "left").withColumn("delay", F.coalesce("delay", F.lit(default)))


def chunk_records(docs: DataFrame, limit: int = 1200, cluster: str = "memory") -> DataFrame:
    """Chunks of documents (doc_id, file_path, text) with id, title, hierarchy, keywords and description."""
    c = md.chunk_documents(docs, limit)
    c = md.own_headings(c.select("doc_id", "start_line", "end_line", "chunk_no", "text"))
    heads = md.headings(docs)
    c = md.section_numbers(md.hierarchy(c, heads), heads)
    topic = docs.select("doc_id", tx.topic_from_filename(F.col("file_path")).alias("topic"), "file_path")
    c = c.join(topic, "doc_id").filter(~tx.is_header_only(F.col("text"), when_blank=False))
    return c.select(tx.chunk_id(F.col("topic"), F.col("section_number"), F.col("start_line"), cluster).alias("id"), F.lit(cluster).alias("cluster"), "topic", F.col("own_heading").alias("title"), tx.version_context(F.col("text")).alias("version_context"), tx.outline_date(F.col("text")).alias("outline_date"), "section_hierarchy", tx.keywords(F.col("text")).alias("keywords"), tx.description(F.col("text")).alias("description"), "file_path", "text", "doc_id", "start_line", "end_line")


def poll_feeds(sources: DataFrame, feeds: DataFrame, now: Column, days: int = 2) -> DataFrame:
    """source_name and the items of feeds(feed_url, xml) that are recent, each link once; undated ones count as recent."""
    s = sources.filter("name is not null and not (rss_feed is null or trim(rss_feed) = '')").select(F.trim("rss_feed").alias("feed_url"), F.col("name").alias("source_name")).distinct()
    items = rd.feed_items(feeds).join(s, "feed_url").filter(flow.recent(F.timestamp_micros("published_utc"), now, days))
    return flow.first_wins(items.select("feed_url", "no", "source_name", "id", "link", "title", "published_utc"), flow.seen_key(F.col("link"), F.col("id")), ["source_name", "feed_url", "no"])


def discover_sources(feeds: DataFrame, known: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """domain, feeds: the domains of dated items of feeds(feed_url, xml) of the last hours that no known source has."""
    items = rd.feed_items(feeds).filter(flow.recent_strict(F.timestamp_micros("published_utc"), now, hours))
    return flow.new_domains(items.select("link", F.col("feed_url").alias("feed")), known)


def fallback_crawl(sources: DataFrame, pages: DataFrame, now: Column, days: int = 2) -> DataFrame:
    """source_name, link and article of the entry pages of sources that have no feed; recent and sufficient ones, each link once."""
    entry = sources.filter(flow.needs_crawl(F.col("rss_feed")) & F.col("name").isNotNull()).select(F.col("name").alias("source_name"), F.posexplode(flow.entry_urls(F.col("base_url"), F.col("sections"))).alias("no", "link")).distinct()
    p = pages.select("page_id", F.col("url").alias("link"), "html").join(entry, "link").join(selectors(sources), "source_name", "left").withColumn("page_id", F.struct("source_name", "no", "page_id", "link"))
    a = extract.cascade(p, "selectors").select("page_id.*", "article").filter(flow.sufficient(F.col("article.title"), F.col("article.text")))
    a = with_instant(a.withColumn("published", F.col("article.published")), "published", out="published_utc").filter(flow.recent(F.timestamp_micros("published_utc"), now, days))
    return flow.first_wins(a.select("source_name", "no", "page_id", "link", "article", "published_utc"), F.nullif(F.col("link"), F.lit("")), ["source_name", "no", "page_id"])


def selector_defaults(url: Column, html: Column, fields: list[str]) -> Column:
    """Stand-in for an analysis of a page's structure: a made-up selector for each field on example pages, else null."""
    made = F.map_from_arrays(F.array(*[F.lit(f"article_{f}_selector") for f in fields]), F.array(*[F.lit(f".dummy-{f}-selector") for f in fields]))
    return F.when(F.contains(url, F.lit("example.com")) & (F.coalesce(html, F.lit("")) != ""), made)


def index_selectors(url: Column) -> Column:
    """The same for a page that lists articles."""
    return F.when(F.contains(url, F.lit("example.com/section")), F.create_map(F.lit("article_link_selector"), F.lit(".dummy-article-link")))


def analyse_source(sources: DataFrame, name: str, html: Column, fields: list[str]) -> DataFrame:
    """The sources with the selectors of one of them made anew and its mark taken away; nothing changes where none are found."""
    found = selector_defaults(F.col("base_url"), html, fields)
    hit = (F.col("name") == name) & found.isNotNull()
    return sources.withColumn("llm_analysis_pending", F.when(hit, F.lit(False)).otherwise(F.col("llm_analysis_pending"))).withColumn("extraction_selectors", F.when(hit, found).otherwise(F.col("extraction_selectors")))


def scan_to_registry(registry: DataFrame, domains: DataFrame, checked: Column) -> DataFrame:
    """The registry with the class and feeds of freshly scanned domains (see scan_policies), their other columns kept."""
    prior = flow.last_wins(registry, "domain", "last_checked")
    d = domains.filter("domain is not null").dropDuplicates(["domain"]).join(prior.select("domain", F.col("permission").alias("prior")), "domain", "left")
    fresh = scan_policies(d).withColumn("last_checked", checked)
    new = fresh.join(prior.drop("permission", "feed_urls", "last_checked"), "domain", "left")
    return flow.upsert(prior, new.select(*[F.col(c) for c in prior.columns]))


def topic_job(docs: DataFrame, least: int = 3, deepest: int = 2, threshold: float = 0.9) -> DataFrame:
    """doc_id, no, slug, text of all topics of the documents that are more than a heading; of equal slugs of a document the last
    one stays, as one file would replace the other."""
    t = md.topics(docs, least, deepest, threshold).filter(~tx.is_header_only(F.col("text")))
    return t.groupBy("doc_id", "slug").agg(F.max(F.struct("no", "text")).alias("t")).select("doc_id", F.col("t.no").alias("no"), "slug", F.col("t.text").alias("text"))


def chunk_job(docs: DataFrame, limit: int = 1200, merge: bool = False, least: int = 3, deepest: int = 2, threshold: float = 0.9) -> DataFrame:
    """Chunk records (see chunk_records) of documents (doc_id, file_path, text) topic by topic; with merge, tiny neighbours of one
    section are joined and described anew."""
    t = through_table(md.topics(docs, least, deepest, threshold).withColumn("topic_id", F.xxhash64("doc_id", "no")), "topics")
    c = chunk_records(t.join(docs.select("doc_id", "file_path"), "doc_id").select(F.col("topic_id").alias("doc_id"), "file_path", "text"), limit)
    c = c.drop("topic").join(t.select(F.col("topic_id").alias("doc_id"), F.col("slug").alias("topic"), F.col("doc_id").alias("document")), "doc_id")
    c = c.withColumn("id", F.regexp_replace(tx.chunk_id(F.col("topic"), F.lit("#"), F.col("start_line")), "#", F.regexp_extract("id", r"_sec([0-9.]+)_L\d+$", 1)))
    if not merge:
        return c
    c = through_table(c, "chunks")
    m = md.merge_tiny(c.withColumn("place", F.struct("start_line", "id")), "doc_id", "place").select("doc_id", F.col("place.id").alias("id"), F.col("text").alias("__t"))
    kept = c.join(m, ["doc_id", "id"])
    return kept.withColumn("text", F.col("__t")).withColumn("keywords", tx.keywords(F.col("__t"))).withColumn("description", tx.description(F.col("__t"))).drop("__t")


def pack_chunks(chunks: DataFrame, limit: int = 1200) -> DataFrame:
    """document, topic, bin and text: the chunks of each topic in the order of their file names, packed up to the limit."""
    f = chunks.select(F.struct("doc_id", "document", "topic").alias("g"), F.concat("id", F.lit(".md")).alias("name"), F.trim("text").alias("text"))
    bins = md.pack(f.select("g", "name", tx.section_prefix(F.col("name")).alias("prefix"), tx.token_count(F.col("text")).alias("n")), "g", "name", "prefix", "n", limit)
    both = f.join(bins, ["g", "name"]).groupBy("g", "bin").agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("t"))  # a bin is bounded by the limit
    return both.select("g.document", "g.topic", "bin", F.col("t")[0]["name"].alias("name"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def chunk_records_one_stage(docs: DataFrame, limit: int = 1200) -> DataFrame:
    """Chunk records of whole documents, without topics; ids without a line, so of equal ids the last one stays."""
    c = chunk_records(docs, limit).withColumn("id", F.regexp_replace("id", r"_L\d+$", ""))
    rest = [x for x in c.columns if x not in ("doc_id", "id")]
    return c.groupBy("doc_id", "id").agg(F.max(F.struct("start_line", *[x for x in rest if x != "start_line"])).alias("r")).select("doc_id", "id", *[F.col("r")[x].alias(x) for x in rest])
