"""Readers for documents, configuration, registries, feeds, sitemaps and chunk folders, and a page source by URL table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.functions.timestamps import with_instant

SOURCE = "name string, base_url string, rss_feed string, sections array<struct<name:string,url:string>>, crawl_interval_minutes int, parser_config_name string, parser_config string, extraction_selectors map<string,string>, llm_analysis_pending boolean"
DOMAIN = "domain string, permission string, feed_urls array<string>, api_endpoints array<string>, contact string, license_info string, last_checked string, etag string, last_modified string"


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """file_path, text of every .md file below path, whole."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[mM][dD]")
    return d.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def source_config(spark: SparkSession, path: str) -> DataFrame:
    """The sources of a configuration file {"sources": [...]}; an unreadable file gives no rows."""
    item = ",".join(f.strip().replace(" ", ":", 1) for f in _fields(SOURCE))
    return spark.read.schema(f"sources array<struct<{item}>>").option("multiLine", True).json(path).selectExpr("inline(sources)")


def _fields(schema: str) -> list[str]:
    out, depth, begin = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[begin:i])
            begin = i + 1
    return [*out, schema[begin:]]


def domain_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("domain")).filter("domain <> ''")


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOMAIN).option("multiLine", True).json(path)


def front_matter(text: Column) -> Column:
    """struct<head, body>: the block between the first line --- and the next one; without both all is body."""
    clean = F.regexp_replace(text, r"\r\n|\r", "\n")
    pattern = r"(?s)^---[ \t]*\n(.*?)(?:^|\n)---[ \t]*(?:\n(.*))?$"
    ok = clean.rlike(pattern)
    return F.struct(F.when(ok, F.regexp_extract(clean, pattern, 1)).alias("head"), F.when(ok, F.regexp_extract(clean, pattern, 2)).otherwise(clean).alias("body"))


def deepest_folders(files: DataFrame, path: str = "file_path") -> DataFrame:
    """dir: folders that hold files and have no folder below them among those that do."""
    dirs = files.select(F.regexp_replace(path, "/[^/]*$", "").alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir"), F.col("dir").alias("own")).filter("dir <> own").select("dir").distinct()
    return dirs.join(above, "dir", "left_anti")


def feed_items(feeds: DataFrame) -> DataFrame:
    """feed_url, no, id, link, title, published_utc (micros) of RSS and Atom texts; entries without a link go.

    Read by pattern, not by an XML parser, so that ill-formed feeds are read as far as they go.
    """
    entries = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))
    e = feeds.filter("xml is not null").select("feed_url", F.posexplode(entries).alias("no", "e"))
    field = lambda *names: F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), r"^<!\[CDATA\[|\]\]>$", "")), F.lit("")) for n in names])
    link = F.coalesce(field("link"), F.nullif(F.regexp_extract("e", r"(?is)<link\b[^>]*href=[\"']([^\"']+)", 1), F.lit("")))
    e = e.select("feed_url", "no", F.coalesce(field("guid", "id"), link).alias("id"), link.alias("link"), field("title").alias("title"), field("pubDate", "published", "updated", "dc:date").alias("__date"))
    return with_instant(e.filter("link is not null"), "__date", out="published_utc").drop("__date")


def sitemaps(maps: DataFrame) -> DataFrame:
    """sitemap_url, kind (sitemap_index or urlset), sitemap_urls, items; an index without addresses has no row."""
    locs = lambda tag: F.filter(F.transform(F.regexp_extract_all("xml", F.lit(rf"(?is)<(?:\w+:)?{tag}\b[^>]*>(.*?)</(?:\w+:)?{tag}>"), F.lit(1)), lambda x: F.struct(F.trim(F.regexp_extract(x, r"(?is)<(?:\w+:)?loc\b[^>]*>(.*?)</(?:\w+:)?loc>", 1)).alias("loc"), F.nullif(F.trim(F.regexp_extract(x, r"(?is)<(?:\w+:)?lastmod\b[^>]*>(.*?)</", 1)), F.lit("")).alias("lastmod"))), lambda x: x["loc"] != "")
    index = F.col("xml").rlike(r"(?i)<(?:\w+:)?sitemapindex\b")
    m = maps.filter("xml is not null").withColumn("kind", F.when(index, "sitemap_index").when(F.col("xml").rlike(r"(?i)<(?:\w+:)?urlset\b"), "urlset"))
    m = m.filter("kind is not null").select("sitemap_url", "kind", F.when(index, F.transform(locs("sitemap"), lambda x: x["loc"])).alias("sitemap_urls"), F.when(~index, locs("url")).alias("items"))
    return m.filter("kind = 'urlset' or size(sitemap_urls) > 0")


def sitemap_closure(roots: DataFrame, maps: DataFrame) -> DataFrame:
    """root, loc, lastmod of everything the sitemaps below the roots list, however deep; every sitemap is opened once per root,
    so circles end."""
    from weftline.session import through_table

    read = sitemaps(maps)
    seen = roots.select(F.col("sitemap_url").alias("root"), "sitemap_url").distinct()
    front = seen
    while True:
        found = front.join(read.filter("kind = 'sitemap_index'"), "sitemap_url").select("root", F.explode("sitemap_urls").alias("sitemap_url")).distinct()
        front = through_table(found.join(seen, ["root", "sitemap_url"], "left_anti"), "sitemaps")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(read.filter("kind = 'urlset'"), "sitemap_url").select("root", F.inline("items")).distinct()


class PageSource(DataSource):
    """spark.read.format("web_pages"): one partition per authority, so that each is visited politely by one task.

    Options: urls (JSON list), backend (module:function that maps a URL to (status, body); the default answers nothing, as
    the engine itself opens no connection), delay (seconds between two pages of an authority).
    """

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return "url string, status int, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        import json

        self.urls = json.loads(options.get("urls", "[]"))
        self.backend, self.delay = options.get("backend", ""), float(options.get("delay", "0"))

    def partitions(self):
        from urllib.parse import urlsplit

        by: dict[str, list[str]] = {}
        for u in self.urls:
            by.setdefault(urlsplit(u).netloc, []).append(u)
        return [InputPartition(v) for v in by.values()] or [InputPartition([])]

    def read(self, partition):
        import importlib
        import time

        fetch = None
        if self.backend:
            module, _, name = self.backend.partition(":")
            fetch = getattr(importlib.import_module(module), name)
        for i, u in enumerate(partition.value):
            if i and self.delay:
                time.sleep(self.delay)
            try:
                status, body = fetch(u) if fetch else (None, None)
                yield (u, status, body, None)
            except Exception as e:  # a page that fails is a row with its error
                yield (u, None, None, str(e))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
