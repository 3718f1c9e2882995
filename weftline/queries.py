"""Queries over the reference operators and the timestamp problem, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import bpe
from weftline.functions import robots as rb
from weftline.functions import text as tx
from weftline.functions import urls as ur
from weftline.operators import extract, flow
from weftline.operators import markdown as md
from weftline.operators.instants import DateField, normalise_instants
from weftline.plans import pipelines as pl
from weftline.session import table as T  # noqa: N812
from weftline.sources import readers as rd

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2025-02-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p5_found(s: SparkSession, sf: str) -> DataFrame:
    fields = [
        DateField(T(s, sf, "feed_items"), "item_no", "published_date_utc", "source_name"),
        DateField(T(s, sf, "sitemap_entries"), "entry_id", "lastmod_utc", "source_name", repeats=True),
        DateField(T(s, sf, "domain_registry"), "domain", "last_modified", repeats=True),
        DateField(T(s, sf, "article_infos"), "info_id", "date", "source_name"),
    ]
    return normalise_instants(fields, T(s, sf, "source_zones"))


# -- links and URLs ------------------------------------------------------------------------------------------------------

_AUTH = "nullif(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')"
_DEPTH = "len(list_filter(string_split(regexp_replace(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda p: p <> ''))"
_WORDS = "(" + " + ".join(f"CAST(contains(lower({{0}}), '{k}') AS INT)" for k in ur.LINK_KEYWORDS) + ")"
_SCORE = f"round((0.6::DOUBLE * ({_WORDS} / 32.0::DOUBLE) + 0.4::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + abs({_DEPTH} - 3)))) / 2.0::DOUBLE, 9)"

def _resolved(base: str, href: str) -> str:
    """SQL of a resolved reference, by a list fold of its own."""
    href = f"trim(translate({href}, chr(9) || chr(10) || chr(13), ''))"
    root, rest = f"coalesce(regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*'), '')", f"substr({href}, length(regexp_extract({href}, '^[^?#]*')) + 1)"
    path, own = f"regexp_extract({href}, '^[^?#]*')", f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    full = f"CASE WHEN {path} LIKE '/%' THEN {path} WHEN contains({own}, '/') THEN regexp_extract({own}, '^.*/') || {path} ELSE '/' || {path} END"
    walked = f"list_reduce(string_split({full}, '/'), lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || x END) || CASE WHEN string_split({full}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END"
    return f"""CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} WHEN {href} LIKE '//%' THEN coalesce(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*:)//', 1), '') || {href}
        WHEN {root} = '' THEN {href} WHEN {href} = '' THEN {base} WHEN {href} LIKE '#%' THEN regexp_replace({base}, '#.*$', '') || {href}
        WHEN {path} = '' THEN {root} || {own} || {rest} ELSE {root} || {walked} || {rest} END"""


_UNWANTED = [f"/{w}" for w in "login signin register signup search privacy terms contact about".split()] + [f"/{w}/" for w in "tag user profile account wp-json".split()] + ["/?replytocom=", "archive.org/web/"]
_ENDINGS = ["/feed/", "/comments/feed/"] + [f".{x}" for x in "pdf zip jpg jpeg png gif css js".split()]
_GIVEN = """replace(trim(regexp_extract(tag, '(?i)[[:space:]]href[[:space:]]*=[[:space:]]*("[^"]*"|''[^'']*''|[^[:space:]"''>]+)', 1), '"'''), '&amp;', '&')"""
_LINKS = f"""
    WITH t AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(?i)<a[[:space:]][^>]*>')) AS tag FROM fetch_results WHERE html IS NOT NULL),
    h AS (SELECT DISTINCT page_id, base, {_GIVEN} AS href FROM t WHERE regexp_matches(tag, '(?i)[[:space:]]href[[:space:]]*=[[:space:]]*[^[:space:]>]')),
    r AS (SELECT page_id, href, {_resolved('base', 'trim(href)')} AS url FROM h WHERE href NOT LIKE 'javascript:%' AND href NOT LIKE 'mailto:%' AND href NOT LIKE '#%'),
    l AS (SELECT DISTINCT page_id, url FROM r WHERE {_AUTH.format('url')} IS NOT NULL AND NOT ({' OR '.join(f"contains(url, '{x}')" for x in _UNWANTED)} OR {' OR '.join(f"url LIKE '%{x}'" for x in _ENDINGS)}))
"""


@query(_LINKS + f", s AS (SELECT page_id, url, {_SCORE.format('url')} AS score FROM l) SELECT page_id, url, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS INT) AS rank FROM s) WHERE rank <= 10")
def page_links_topk(s: SparkSession, sf: str) -> DataFrame:
    return flow.top_links(flow.page_links(T(s, sf, "fetch_results")))


@query(_LINKS + "SELECT page_id, count(*) AS links FROM l GROUP BY page_id")
def page_link_counts(s: SparkSession, sf: str) -> DataFrame:
    return flow.page_links(T(s, sf, "fetch_results")).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@query(f"SELECT {_AUTH.format('link')} AS authority, count(*) AS items FROM feed_items GROUP BY 1")
def url_authority_counts(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "feed_items").groupBy(ur.authority(F.col("link")).alias("authority")).agg(F.count(F.lit(1)).alias("items"))


@query(r"""SELECT item_no, CASE WHEN coalesce(link, '') = '' THEN 'untitled' ELSE left(regexp_replace(regexp_replace(regexp_replace(link, '^https?://', ''), '[/:?*"<>|]', '_', 'g'), '[^\p{L}\p{N}_.\-]', '_', 'g'), 150) END AS file_name FROM feed_items""")
def url_sanitize(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "feed_items").select("item_no", ur.sanitize_filename(F.col("link")).alias("file_name"))


@query(f"SELECT item_no, {_SCORE.format('link')} AS score FROM feed_items WHERE link IS NOT NULL")
def url_score(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "feed_items").filter("link is not null").select("item_no", ur.link_score(F.col("link")).alias("score"))


@query(f"SELECT item_no, {_resolved('source_feed_url', 'link')} AS url FROM feed_items")
def url_resolve(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "feed_items").select("item_no", ur.resolve(F.col("source_feed_url"), F.col("link")).alias("url"))


@query(_LINKS + "SELECT page_id, url, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY url) AS INT) AS rank FROM l) WHERE rank <= 10")
def page_links_first(s: SparkSession, sf: str) -> DataFrame:
    return flow.first_links(flow.page_links(T(s, sf, "fetch_results")))


@query("SELECT DISTINCT source_sitemap_url, 'Sitemap: ' || string_split(regexp_replace(regexp_replace(source_sitemap_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/')[-1] AS title FROM sitemap_entries WHERE source_sitemap_url IS NOT NULL")
def sitemap_titles(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "sitemap_entries").filter("source_sitemap_url is not null").select("source_sitemap_url", ur.sitemap_title(F.col("source_sitemap_url")).alias("title")).distinct()


# -- queue and sources -----------------------------------------------------------------------------------------------------


def _queue(s: SparkSession, sf: str) -> DataFrame:
    a = T(s, sf, "feed_items").select("id", "link", "title", "source_name", F.col("item_no").alias("arrival"))
    b = T(s, sf, "sitemap_entries").select(F.col("loc").alias("link"), "source_name", F.col("entry_id").alias("arrival"))
    c = T(s, sf, "article_infos").select("link", "title", "source_name", F.col("info_id").alias("arrival"))
    return flow.union_producers(a, b, c)


_QUEUE = """WITH q AS (SELECT id, link, title, source_name, item_no AS arrival, 0 AS producer FROM feed_items
    UNION ALL SELECT NULL, loc, NULL, source_name, entry_id, 1 FROM sitemap_entries UNION ALL SELECT NULL, link, title, source_name, info_id, 2 FROM article_infos),
    d AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(link, ''), nullif(id, '')) ORDER BY producer, arrival) AS r FROM q WHERE coalesce(nullif(link, ''), nullif(id, '')) IS NOT NULL)
"""


@query(_QUEUE + "SELECT id, link, title, source_name, arrival, producer FROM d WHERE r = 1")
def queue_first_wins(s: SparkSession, sf: str) -> DataFrame:
    return flow.first_wins(_queue(s, sf), flow.seen_key(F.col("link"), F.col("id")), ["producer", "arrival"])


@query(_QUEUE + "SELECT source_name, count(*) AS added FROM d WHERE r = 1 GROUP BY source_name")
def items_added_per_source(s: SparkSession, sf: str) -> DataFrame:
    return queue_first_wins(s, sf).groupBy("source_name").agg(F.count(F.lit(1)).alias("added"))


@query(_QUEUE + ", o AS (SELECT link, producer, arrival FROM d WHERE r = 1 ORDER BY producer, arrival LIMIT 1000) SELECT * FROM o")
def first_results_kept(s: SparkSession, sf: str) -> DataFrame:
    return flow.first_n(queue_first_wins(s, sf).select("link", "producer", "arrival"), ["producer", "arrival"])


@query(f"SELECT item_no FROM feed_items WHERE fetched_at IS NULL OR fetched_at >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 10 DAY")
def recency_kept(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "feed_items").filter(flow.recent(F.col("fetched_at"), F.lit(NOW).cast("timestamp"), 10)).select("item_no")


@query(f"SELECT item_no FROM feed_items WHERE fetched_at >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 240 HOUR")
def recency_strict(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "feed_items").filter(flow.recent_strict(F.col("fetched_at"), F.lit(NOW).cast("timestamp"), 240)).select("item_no")


@query(f"""WITH m AS (SELECT {_AUTH.format('link')} AS domain, source_feed_url AS feed FROM feed_items)
    SELECT domain, array_to_string(list_sort(list(DISTINCT feed)), ' ') AS feeds FROM m WHERE domain IS NOT NULL AND lower(domain) NOT IN (SELECT lower({_AUTH.format('base_url')}) FROM sources WHERE {_AUTH.format('base_url')} IS NOT NULL) GROUP BY domain""")
def new_source_domains(s: SparkSession, sf: str) -> DataFrame:
    m = T(s, sf, "feed_items").select("link", F.col("source_feed_url").alias("feed"))
    return flow.new_domains(m, T(s, sf, "sources")).select("domain", F.array_join("feeds", " ").alias("feeds"))


@query("""SELECT item_no, f.source_name, s.base_url FROM feed_items f LEFT JOIN (SELECT name, min(base_url) AS base_url FROM sources GROUP BY name) s ON f.source_name = s.name""")
def source_left_join(s: SparkSession, sf: str) -> DataFrame:
    return flow.with_source(T(s, sf, "feed_items").select("item_no", "source_name"), T(s, sf, "sources")).select("item_no", "source_name", "base_url")


@query("""SELECT name, coalesce(parser_config_name, parser_config) AS parser_config_name, coalesce(llm_analysis_pending, extraction_selectors IS NULL OR cardinality(extraction_selectors) = 0) AS llm_analysis_pending,
    coalesce(trim(rss_feed), '') = '' AS needs_crawl FROM sources""")
def source_migration(s: SparkSession, sf: str) -> DataFrame:
    return flow.migrate_sources(T(s, sf, "sources")).select("name", "parser_config_name", "llm_analysis_pending", flow.needs_crawl(F.col("rss_feed")).alias("needs_crawl"))


@query("SELECT name, array_to_string(list_prepend(base_url, list_filter(list_transform(coalesce(sections, []), lambda x: x.url), lambda u: u <> base_url)), ' ') AS entries FROM sources")
def source_entry_urls(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "sources").select("name", F.array_join(flow.entry_urls(F.col("base_url"), F.col("sections")), " ").alias("entries"))


@query("SELECT name, coalesce(len(list_filter(map_keys(extraction_selectors), lambda k: k LIKE '%\\_selector' ESCAPE '\\')) > 0 AND NOT list_contains(map_keys(extraction_selectors), '_is_json_css_schema'), false) AS old_form FROM sources")
def source_selector_form(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "sources").select("name", flow.old_selectors(F.col("extraction_selectors")).alias("old_form"))


# -- log, limits, change -----------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, least(1.0::DOUBLE * pow(2.0::DOUBLE, least(count(*) FILTER (WHERE event_type = 'error'), 60)), 300.0::DOUBLE) AS delay FROM events GROUP BY user_id")
def rate_limit_backoff(s: SparkSession, sf: str) -> DataFrame:
    e = T(s, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    return e.withColumn("delay", flow.backoff(F.lit(1.0), F.col("errors")))


@query(f"SELECT page_id, coalesce(TRY_CAST(metadata['status'] AS INT) IN (429, 503), false) OR coalesce(regexp_matches(lower(html), '{flow.BLOCK_WORDS}'), false) AS limited FROM fetch_results")
def pages_rate_limited(s: SparkSession, sf: str) -> DataFrame:
    status = F.expr("try_cast(metadata['status'] as int)")
    return T(s, sf, "fetch_results").select("page_id", flow.rate_limited(status, F.col("html")).alias("limited"))


@query("SELECT page_id FROM fetch_results WHERE coalesce(lower(trim(string_split(metadata['content_type'], ';')[1])) IN ('text/html', 'text/plain', 'application/xhtml+xml'), false)")
def pages_of_text_type(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "fetch_results").filter(flow.is_page_type(F.col("metadata")["content_type"])).select("page_id")


@query("SELECT event_id, upper(event_type) AS type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def event_log_last(s: SparkSession, sf: str) -> DataFrame:
    return flow.last_n(T(s, sf, "events"), [F.col("ts"), F.col("event_id")], 100).select("event_id", F.upper("event_type").alias("type"))


@query("SELECT upper(event_type) AS type, count(*) AS n FROM events GROUP BY 1")
def event_type_counts(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "events").groupBy(F.upper("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, CASE WHEN row_number() OVER w > 1 THEN i IS DISTINCT FROM lag(i) OVER w END AS changed FROM (SELECT page_id, url, fetched_at, md5(html) AS i FROM fetch_results)
    WINDOW w AS (PARTITION BY url ORDER BY fetched_at, page_id)""")
def site_change(s: SparkSession, sf: str) -> DataFrame:
    p = T(s, sf, "fetch_results").select("page_id", "url", "fetched_at", F.md5("html").alias("i"))
    return flow.changes_over_time(p, "url", ["fetched_at", "page_id"], F.col("i")).select("page_id", "changed")


@query("SELECT (SELECT count(*) FROM feed_items) AS queued, (SELECT count(DISTINCT source_name) FROM feed_items) AS sources, (SELECT count(*) FROM fetch_results WHERE html IS NOT NULL) AS fetched")
def run_summary(s: SparkSession, sf: str) -> DataFrame:
    q = T(s, sf, "feed_items").agg(F.count(F.lit(1)).alias("queued"), F.countDistinct("source_name").alias("sources"))
    f = T(s, sf, "fetch_results").agg(F.count("html").alias("fetched"))
    return q.withColumn("k", F.lit(1)).join(f.withColumn("k", F.lit(1)), "k").drop("k")


@query("SELECT item_no, CASE WHEN length(title) <= 40 THEN title ELSE left(title, 20) || '...' || right(title, 20) END AS snippet FROM feed_items")
def log_snippets(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "feed_items").select("item_no", tx.snippet(F.col("title"), 40).alias("snippet"))


@query("SELECT event_id, 'ERROR' AS type, 'events' AS component, 'urn:' || user_id AS url FROM events WHERE event_type = 'error'")
def failure_records(s: SparkSession, sf: str) -> DataFrame:
    e = T(s, sf, "events").filter("event_type = 'error'").select("event_id", flow.failure(F.lit("events"), F.lit("failed"), F.concat(F.lit("urn:"), F.col("user_id").cast("string")), F.create_map(F.lit("props"), F.col("props"))).alias("f"))
    return e.select("event_id", F.col("f.type").alias("type"), F.col("f.details")["component"].alias("component"), F.col("f.details")["url"].alias("url"))


# -- registry and policy -----------------------------------------------------------------------------------------------------


_ROW = ["last_checked", "permission", "contact", "license_info", "etag", "last_modified"]


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in _ROW)}) AS r FROM domain_registry WHERE domain IS NOT NULL)
    SELECT domain, {', '.join(_ROW)} FROM d WHERE r = 1""")
def registry_last_wins(s: SparkSession, sf: str) -> DataFrame:
    return flow.last_wins(T(s, sf, "domain_registry").select("domain", *_ROW), "domain", "last_checked").select("domain", *_ROW)


@query(r"""SELECT domain, CASE WHEN regexp_matches(tos, '(?i)creative\s+commons') THEN 'green' WHEN contains(lower(tos), 'scrap') THEN 'red' WHEN length(domain) % 3 = 0 THEN 'red'
    WHEN coalesce(lower(prior), 'yellow') = 'yellow' AND coalesce(contains(lower(home), 'api'), false) THEN 'green' ELSE coalesce(lower(prior), 'yellow') END AS permission
    FROM (SELECT DISTINCT domain, license_info AS tos, contact AS home, permission AS prior FROM domain_registry WHERE domain IS NOT NULL)""")
def policy_class(s: SparkSession, sf: str) -> DataFrame:
    d = T(s, sf, "domain_registry").filter("domain is not null").select("domain", F.col("license_info").alias("tos"), F.col("contact").alias("home"), F.col("permission").alias("prior")).distinct()
    d = d.withColumn("robots", F.when(F.length("domain") % 3 == 0, "User-agent: *\nDisallow: /x")).withColumn("sitemap", F.lit(None).cast("string"))
    return pl.scan_policies(d).select("domain", "permission")


def _robots(s: SparkSession, sf: str) -> DataFrame:
    """authority, body: a robots.txt for every authority of the feed items, of three kinds by the length of its name."""
    a = T(s, sf, "feed_items").select(ur.authority(F.col("link")).alias("authority")).filter("authority is not null").distinct()
    site = F.concat(F.lit("\nSitemap: https://"), F.col("authority"), F.lit("/map.xml\nsitemap: https://"), F.col("authority"), F.lit("/news.xml\n"))
    own = F.lit("User-agent: TestBot\nCrawl-delay: 5\nDisallow: /2024/ # old\nAllow: /\n\nUser-agent: *\nCrawl-delay: 1\nDisallow: /\n")
    every = F.concat(F.lit("User-agent: *\nAllow: /2025/0\nDisallow: /2025/\nCrawl-delay: x\nCrawl-delay: 2.5"), site)
    k = F.length("authority") % 3
    return a.select("authority", F.when(k == 0, own).when(k == 1, every).otherwise("# nothing\nUser-agent: other\nDisallow: /").alias("body"))


_KIND = f"length({_AUTH.format('link')}) % 3"
_PATH = "regexp_replace(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')"


@query(f"SELECT item_no, coalesce(CASE {_KIND} WHEN 0 THEN NOT ({_PATH} LIKE '/2024/%') WHEN 1 THEN {_PATH} LIKE '/2025/0%' OR NOT {_PATH} LIKE '/2025/%' END, true) AS allowed FROM feed_items WHERE link IS NOT NULL")
def robots_allow(s: SparkSession, sf: str) -> DataFrame:
    u = T(s, sf, "feed_items").filter("link is not null").select("item_no", F.col("link").alias("url"))
    return rb.allowed(u, rb.rules(_robots(s, sf)), "TestBot").select("item_no", "allowed")


@query(f"SELECT DISTINCT {_AUTH.format('link')} AS authority, CASE {_KIND} WHEN 0 THEN 5.0::DOUBLE ELSE 2.5::DOUBLE END AS own, CASE {_KIND} WHEN 0 THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END AS other FROM feed_items WHERE {_KIND} < 2")
def robots_delay(s: SparkSession, sf: str) -> DataFrame:
    r = _robots(s, sf)
    own, other = rb.crawl_delays(r, "TestBot").withColumnRenamed("delay", "own"), rb.crawl_delays(r, "none").withColumnRenamed("delay", "other")
    return own.join(other, "authority")


@query(f"SELECT DISTINCT 'https://' || {_AUTH.format('link')} || f AS sitemap FROM feed_items, (VALUES ('/map.xml'), ('/news.xml')) AS t(f) WHERE {_KIND} = 1")
def robots_sitemaps(s: SparkSession, sf: str) -> DataFrame:
    return _robots(s, sf).select(F.explode(rb.sitemap_lines(F.col("body"))).alias("sitemap")).distinct()


@query("SELECT s.name, s.a AS authority, coalesce(d.delay, 1.0::DOUBLE) AS delay FROM (SELECT name, nullif(regexp_extract(base_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') AS a FROM sources) s LEFT JOIN (SELECT DISTINCT nullif(regexp_extract(base_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') AS a, (length(base_url) % 7)::DOUBLE AS delay FROM sources WHERE length(base_url) % 2 = 0) d ON d.a = s.a")
def prime_domains(s: SparkSession, sf: str) -> DataFrame:
    own = T(s, sf, "sources").select(ur.authority(F.col("base_url")).alias("authority"), F.length("base_url").alias("n")).filter("authority is not null and n % 2 = 0").distinct()
    robots = own.select("authority", F.concat(F.lit("User-agent: *\nCrawl-delay: "), (F.col("n") % 7).cast("string")).alias("body"))
    return pl.prime_domains(T(s, sf, "sources"), rb.crawl_delays(robots))


# -- feeds and sitemaps --------------------------------------------------------------------------------------------------------


@query("SELECT CAST(item_no AS VARCHAR) AS feed_url, coalesce(nullif(trim(id), ''), trim(link)) AS id, trim(link) AS link, nullif(trim(title), '') AS title FROM feed_items WHERE trim(link) <> ''")
def rss_items(s: SparkSession, sf: str) -> DataFrame:
    tag = lambda n, v: F.coalesce(F.concat(F.lit(f"<{n}><![CDATA["), v, F.lit(f"]]></{n}>\n")), F.lit(""))
    xml = F.concat(F.lit("<rss version='2.0'><channel><item>"), tag("title", F.col("title")), tag("link", F.col("link")), tag("guid", F.col("id")), F.lit("</item><item><title>no link</title></item></channel></rss>"))
    return rd.feed_items(T(s, sf, "feed_items").select(F.col("item_no").cast("string").alias("feed_url"), xml.alias("xml"))).select("feed_url", "id", "link", "title")


@query("SELECT DISTINCT 'index-' || entry_id AS root, trim(loc) AS loc, nullif(trim(lastmod_utc), '') AS lastmod FROM sitemap_entries WHERE trim(loc) <> ''")
def sitemap_urls(s: SparkSession, sf: str) -> DataFrame:
    e = T(s, sf, "sitemap_entries").select(F.col("entry_id").cast("string").alias("n"), "loc", "lastmod_utc")
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = e.select(F.concat(F.lit("index-"), "n").alias("sitemap_url"), F.concat(F.lit(f"<sitemapindex {ns}><sitemap><loc>map-"), "n", F.lit("</loc></sitemap><sitemap><loc>index-"), "n", F.lit("</loc></sitemap></sitemapindex>")).alias("xml"))
    own = e.select(F.concat(F.lit("map-"), "n").alias("sitemap_url"), F.concat(F.lit(f"<urlset {ns}><url><loc>"), F.coalesce("loc", F.lit("")), F.lit("</loc><lastmod>"), F.coalesce("lastmod_utc", F.lit("")), F.lit("</lastmod></url></urlset>")).alias("xml"))
    return rd.sitemap_closure(index.select("sitemap_url"), index.unionByName(own).distinct())


# -- Markdown --------------------------------------------------------------------------------------------------------------------

_DOCS = r"d AS (SELECT section_id AS doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM md_sections WHERE text IS NOT NULL), a AS (SELECT doc_id, string_split(t, chr(10)) AS x FROM d), b AS (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS ls FROM a)"
_HEADS = rf"{_DOCS}, l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM b), h AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(length(regexp_extract(line, '{tx.HEADING}', 1)) AS INT) AS level, nullif(regexp_extract(line, '{tx.HEADING}', 2), '') AS section_number, trim(regexp_extract(line, '{tx.HEADING}', 3)) AS heading_text FROM l WHERE regexp_matches(line, '{tx.HEADING}'))"


def _md(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "md_sections").select(F.col("section_id").alias("doc_id"), "text", "file_path")


@query(f"WITH {_HEADS} SELECT doc_id, line_no, level, section_number, heading_text FROM h")
def md_headings(s: SparkSession, sf: str) -> DataFrame:
    return md.headings(_md(s, sf))


@query(f"WITH {_DOCS} SELECT doc_id, array_to_string(list_filter(list_transform(ls, lambda x: regexp_extract(x, '{tx.NUMBERED}', 1)), lambda x: x <> ''), '|') AS found FROM b")
def md_numbered_headings(s: SparkSession, sf: str) -> DataFrame:
    return _md(s, sf).filter("text is not null").select("doc_id", F.array_join(md.numbered_headings(F.col("text")), "|").alias("found"))


@query(f"WITH {_HEADS}, c AS (SELECT doc_id, line_no AS start_line FROM h WHERE level = 2 UNION SELECT doc_id, 0 FROM b) SELECT * FROM (SELECT c.doc_id, start_line, CAST(coalesce(lead(start_line) OVER (PARTITION BY c.doc_id ORDER BY start_line), len(ls)) AS INT) AS end_line FROM c JOIN b ON b.doc_id = c.doc_id) WHERE end_line > start_line")
def md_section_bounds(s: SparkSession, sf: str) -> DataFrame:
    return md.sections(_md(s, sf))


_SECT = f"{_HEADS}, c AS (SELECT doc_id, line_no AS start_line FROM h WHERE level = 2 UNION SELECT doc_id, 0 FROM b), e AS (SELECT c.doc_id, start_line, CAST(coalesce(lead(start_line) OVER (PARTITION BY c.doc_id ORDER BY start_line), len(ls)) AS INT) AS end_line, ls FROM c JOIN b ON b.doc_id = c.doc_id), w AS (SELECT doc_id, start_line, end_line, array_to_string(ls[start_line + 1:end_line], chr(10)) AS text FROM e WHERE end_line > start_line)"


@query(f"WITH {_SECT} SELECT doc_id, start_line, md5(text) AS text_md5 FROM w")
def md_section_texts(s: SparkSession, sf: str) -> DataFrame:
    return md.section_texts(_md(s, sf)).select("doc_id", "start_line", F.md5("text").alias("text_md5"))


@query(f"WITH {_SECT} SELECT w.doc_id, w.start_line, coalesce(string_agg(h.heading_text, '|' ORDER BY h.line_no), '') AS hierarchy FROM w LEFT JOIN h ON h.doc_id = w.doc_id AND h.line_no <= w.start_line GROUP BY w.doc_id, w.start_line")
def md_hierarchy(s: SparkSession, sf: str) -> DataFrame:
    d = _md(s, sf)
    return md.hierarchy(md.sections(d), md.headings(d)).select("doc_id", "start_line", F.array_join("section_hierarchy", "|").alias("hierarchy"))


@query(f"WITH {_HEADS} SELECT doc_id, CASE WHEN count(*) FILTER (WHERE level = 2) >= 3 THEN 2 WHEN count(*) FILTER (WHERE level = 3) >= 3 THEN 3 END AS level FROM h GROUP BY doc_id")
def md_split_level(s: SparkSession, sf: str) -> DataFrame:
    return md.split_level(md.headings(_md(s, sf)), deepest=3)


@query(f"WITH {_HEADS}, f AS (SELECT s.section_id, min(h.line_no) AS l FROM md_sections s JOIN h ON h.doc_id = s.section_id AND h.heading_text = s.own_heading GROUP BY s.section_id), t AS (SELECT section_id, list_filter(string_split(coalesce(own_heading, ''), '.'), lambda x: regexp_full_match(x, '[0-9]+')) AS ns FROM md_sections) SELECT s.section_id AS doc_id, coalesce(h.section_number, CASE WHEN len(ns) = 0 THEN '1' ELSE array_to_string(list_append(list_transform(ns[:-2], lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), CAST(CAST(ns[-1] AS BIGINT) + 1 AS VARCHAR)), '.') END) AS section_number FROM md_sections s JOIN t ON t.section_id = s.section_id LEFT JOIN f ON f.section_id = s.section_id LEFT JOIN h ON h.doc_id = s.section_id AND h.line_no = f.l")
def md_section_numbers(s: SparkSession, sf: str) -> DataFrame:
    d = T(s, sf, "md_sections").select(F.col("section_id").alias("doc_id"), "own_heading", F.lit(2147483647).alias("start_line"), "text")
    out = md.section_numbers(d.select("doc_id", "own_heading", "start_line"), md.headings(d))
    return out.select("doc_id", "section_number")


@query(r"SELECT section_id, trim(regexp_replace(lower(own_heading), '[^a-z0-9]+', '_', 'g'), '_') AS slug, 'memory_' || topic || '_sec1_L' || start_line AS id FROM md_sections")
def chunk_ids(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "md_sections").select("section_id", tx.slugify(F.col("own_heading")).alias("slug"), tx.chunk_id(F.col("topic"), F.lit("1"), F.col("start_line")).alias("id"))


_STOPPED = ", ".join("'" + w.replace("'", "''") + "'" for w in [*tx.DOMAIN_STOP, *tx.STOP_WORDS])


@query(rf"SELECT section_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(text, '`([^`]+)`', 1), list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)*$'))), lambda w: length(w) > 2 AND w NOT IN ({_STOPPED}))))[1:7], '|') AS keywords FROM md_sections WHERE text IS NOT NULL")
def md_keywords(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "md_sections").filter("text is not null").select("section_id", F.array_join(tx.keywords(F.col("text")), "|").alias("keywords"))


@query(r"SELECT section_id, coalesce(nullif(regexp_extract(text, '(?m)^\*[ \t]*Description:[ \t]*(.+)$', 1), ''), nullif(regexp_extract(text, '(?m)^\*\*[ \t]*[0-9.]+[ \t]*Purpose:[ \t]*(.+)$', 1), ''), '') AS description FROM md_sections WHERE text IS NOT NULL")
def md_description(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "md_sections").filter("text is not null").select("section_id", tx.description(F.col("text")).alias("description"))


@query(rf"WITH {_DOCS} SELECT b.doc_id, CAST(len(ls) AS INT) AS lines, CAST(len(regexp_extract_all(s.text, '{tx.TOKEN}')) AS INT) AS tokens FROM b JOIN md_sections s ON s.section_id = b.doc_id")
def md_counts(s: SparkSession, sf: str) -> DataFrame:
    return _md(s, sf).filter("text is not null").select("doc_id", tx.line_count(F.col("text")).alias("lines"), tx.token_count(F.col("text")).alias("tokens"))


@query(rf"WITH {_DOCS}, n AS (SELECT doc_id, list_filter(ls, lambda x: trim(x) <> '') AS f FROM b) SELECT doc_id, CASE WHEN len(f) = 0 THEN true ELSE len(f) = 1 AND regexp_matches(f[1], '^\s*#+\s+') END AS header_only FROM n")
def md_header_only(s: SparkSession, sf: str) -> DataFrame:
    return _md(s, sf).filter("text is not null").select("doc_id", tx.is_header_only(F.col("text")).alias("header_only"))


@query("SELECT section_id, array_to_string(string_split(regexp_replace(string_split(file_path, '/')[-1], '.{3}$', ''), '_')[2:-2], '_') AS topic FROM md_sections WHERE file_path IS NOT NULL")
def md_file_topic(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "md_sections").filter("file_path is not null").select("section_id", tx.topic_from_filename(F.col("file_path")).alias("topic"))


@query("SELECT section_id, len(regexp_extract_all(text, '(?s)```.*?```'))::INT AS fences, true AS restored FROM md_sections WHERE text IS NOT NULL")
def md_fences(s: SparkSession, sf: str) -> DataFrame:
    f = T(s, sf, "md_sections").filter("text is not null").select("section_id", "text", tx.fences_out(F.col("text")).alias("f"))
    return f.select("section_id", F.size("f.code").alias("fences"), (tx.fences_in(F.col("f.text"), F.col("f.code")) == F.col("text")).alias("restored"))


@query()
def md_chunks(s: SparkSession, sf: str) -> DataFrame:
    return md.chunk_documents(_md(s, sf), 300)


@query()
def md_chunk_records(s: SparkSession, sf: str) -> DataFrame:
    return pl.chunk_records(_md(s, sf), 300)


@query()
def md_merged_sections(s: SparkSession, sf: str) -> DataFrame:
    return md.merge_similar(md.section_texts(_md(s, sf)), "doc_id", "start_line", "text")


_TERMS = r"""WITH p AS (SELECT section_id, coalesce(text, '') AS a, coalesce(own_heading, '') AS b FROM md_sections), k AS (SELECT section_id, regexp_extract_all(lower(a), '[\p{L}\p{N}_]{2,}') AS ta, regexp_extract_all(lower(b), '[\p{L}\p{N}_]{2,}') AS tb FROM p),
    x AS (SELECT section_id, w, count(*) AS n FROM (SELECT section_id, unnest(ta) AS w FROM k) GROUP BY 1, 2), y AS (SELECT section_id, w, count(*) AS n FROM (SELECT section_id, unnest(tb) AS w FROM k) GROUP BY 1, 2),
    z AS (SELECT coalesce(x.section_id, y.section_id) AS section_id, coalesce(x.n, 0)::DOUBLE AS n, coalesce(y.n, 0)::DOUBLE AS m, CASE WHEN x.n IS NOT NULL AND y.n IS NOT NULL THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + ln(1.5::DOUBLE) END AS idf FROM x FULL JOIN y ON x.section_id = y.section_id AND x.w = y.w),
    g AS (SELECT section_id, sum(n * m) AS dot, sqrt(sum(pow(n * idf, 2))) AS na, sqrt(sum(pow(m * idf, 2))) AS nb FROM z GROUP BY section_id)
    SELECT p.section_id, CASE WHEN g.section_id IS NULL THEN 1.0::DOUBLE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE ELSE round(dot / (na * nb), 9) END AS similarity FROM p LEFT JOIN g ON g.section_id = p.section_id"""


@query(_TERMS)
def tfidf_pairs(s: SparkSession, sf: str) -> DataFrame:
    return md.pair_cosine(T(s, sf, "md_sections"), ["section_id"], "text", "own_heading")


@query(rf"""WITH RECURSIVE f AS (SELECT file_path, topic || '_L' || lpad(CAST(section_id AS VARCHAR), 9, '0') || '.md' AS name, topic AS prefix, len(regexp_extract_all(coalesce(text, ''), '{tx.TOKEN}')) AS n FROM md_sections WHERE file_path IS NOT NULL AND topic IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY name) AS k FROM f),
    r AS (SELECT file_path, name, prefix, k, n AS s, 0 AS bin FROM o WHERE k = 1 UNION ALL SELECT o.file_path, o.name, o.prefix, o.k, CASE WHEN o.prefix = r.prefix AND r.s + o.n <= 1200 THEN r.s + o.n ELSE o.n END, CASE WHEN o.prefix = r.prefix AND r.s + o.n <= 1200 THEN r.bin ELSE r.bin + 1 END FROM r JOIN o ON o.file_path = r.file_path AND o.k = r.k + 1)
    SELECT file_path, name, bin FROM r""")
def pack_greedy(s: SparkSession, sf: str) -> DataFrame:
    f = T(s, sf, "md_sections").filter("file_path is not null and topic is not null")
    f = f.select("file_path", F.concat("topic", F.lit("_L"), F.lpad(F.col("section_id").cast("string"), 9, "0"), F.lit(".md")).alias("name"), tx.token_count(F.coalesce("text", F.lit(""))).alias("n"))
    return md.pack(f.withColumn("prefix", tx.section_prefix(F.col("name"))), "file_path", "name", "prefix", "n")


@query("SELECT section_id, 'id: ' || section_id AS head, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS body_md5 FROM md_sections WHERE text IS NOT NULL")
def front_matter(s: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("---\nid: "), F.col("section_id").cast("string"), F.lit("\n---\n"), F.col("text"))
    return T(s, sf, "md_sections").filter("text is not null").select("section_id", rd.front_matter(t).alias("f")).select("section_id", F.col("f.head").alias("head"), F.md5("f.body").alias("body_md5"))


# -- extraction ------------------------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title FROM fetch_results WHERE html IS NOT NULL".replace('\\"', '"'))
def page_titles(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "fetch_results").filter("html is not null").select("page_id", extract.page_title(F.col("html")).alias("title"))


_MAIN = r"CASE WHEN regexp_matches(html, '(?i)<main[ >]') THEN string_split_regex(string_split_regex(html, '(?i)<main[^>]*>')[2], '(?i)</main\s*>')[1] END"


@query(rf"""WITH d AS (SELECT page_id, unnest(regexp_extract_all({_MAIN}, '(?i)<div\s[^>]*>')) AS tag FROM fetch_results), k AS (SELECT page_id, row_number() OVER () AS o, string_split_regex(trim(trim(regexp_extract(tag, '(?i)\sclass\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1), '"''')), '\s+') AS cs FROM d),
    u AS (SELECT page_id, o, unnest(cs) AS css_class, unnest(range(len(cs))) AS i FROM k), g AS (SELECT page_id, css_class, count(*) AS n, min(o * 1000 + i) AS f FROM u WHERE css_class <> '' GROUP BY ALL HAVING count(*) >= 2)
    SELECT page_id, css_class, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, f) AS r FROM g) WHERE r = 1""")
def recurrent_class(s: SparkSession, sf: str) -> DataFrame:
    return extract.recurrent_class(T(s, sf, "fetch_results")).select("page_id", "css_class", "n")


@query()
def recurrent_sample(s: SparkSession, sf: str) -> DataFrame:
    return extract.recurrent_class(T(s, sf, "fetch_results")).select("page_id", "sample")


def _with_selectors(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "fetch_results").join(pl.selectors(T(s, sf, "sources")), "source_name", "left")


@query()
def article_cascade(s: SparkSession, sf: str) -> DataFrame:
    return extract.cascade(_with_selectors(s, sf), "selectors").select("page_id", "article.*")


@query()
def selector_articles(s: SparkSession, sf: str) -> DataFrame:
    return _with_selectors(s, sf).select("page_id", extract.by_selectors(F.col("html"), F.col("selectors")).alias("a")).select("page_id", "a.*").filter("method is not null")


@query(r"""SELECT item_no, array_to_string(list_filter(list_transform(CASE item_no % 3 WHEN 0 THEN string_split(title, ',') ELSE [replace(title, '"', '')] END, lambda x: trim(x)), lambda x: x <> ''), '|') AS authors FROM feed_items WHERE title IS NOT NULL AND NOT regexp_matches(title, '^\s*[\[{]')""")
def author_names(s: SparkSession, sf: str) -> DataFrame:
    """Names as a text, as a JSON object and as a JSON list; titles stand in for names, so those that look like JSON are left out."""
    f = T(s, sf, "feed_items").filter(F.col("title").isNotNull() & ~F.col("title").rlike(r"^\s*[\[{]"))
    bare = F.replace("title", F.lit('"'), F.lit(""))
    said = F.when(F.col("item_no") % 3 == 0, F.col("title")).when(F.col("item_no") % 3 == 1, F.concat(F.lit('{"@type": "Person", "name": "'), bare, F.lit('"}'))).otherwise(F.concat(F.lit('["'), bare, F.lit('"]')))
    return f.select("item_no", F.array_join(extract.authors(said), "|").alias("authors"))


@query(f"""WITH t AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<link[[:space:]][^>]*>')) AS tag FROM fetch_results), l AS (SELECT page_id, url, {_GIVEN} AS href FROM t
    WHERE contains(lower(tag), 'application/rss+xml') AND regexp_matches(lower(tag), 'rel="?''?[^"''>]*alternate')) SELECT DISTINCT page_id, {_resolved('url', 'href')} AS feed FROM l WHERE href <> ''""")
def page_feed_links(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "fetch_results").select("page_id", F.explode(extract.feed_links(F.col("html"), F.col("url"))).alias("feed"))


@query()
def queue_articles(s: SparkSession, sf: str) -> DataFrame:
    pages = T(s, sf, "fetch_results")
    items = flow.first_wins(_queue(s, sf).unionByName(pages.select(F.lit(None).cast("string").alias("id"), F.col("url").alias("link"), F.lit(None).cast("string").alias("title"), "source_name", F.col("page_id").alias("arrival"), F.lit(3).alias("producer"))), flow.seen_key(F.col("link"), F.col("id")), ["producer", "arrival"])
    return pl.process_queue(items, T(s, sf, "sources"), pages).select("link", "source_name", "title", "extraction_method")


@query()
def fallback_articles(s: SparkSession, sf: str) -> DataFrame:
    pages, sources = T(s, sf, "fetch_results"), T(s, sf, "sources")
    homes = pages.filter("source_name is not null and html is not null").groupBy("source_name").agg(F.min(F.struct("page_id", "url", "html")).alias("p"))
    entry = sources.join(homes, F.col("name") == F.col("source_name")).select("name", F.col("p.url").alias("base_url"), F.lit(None).cast("string").alias("rss_feed"), "sections", "extraction_selectors")
    return pl.fallback_crawl(entry, pages, F.lit(NOW).cast("timestamp"), 3650).select("source_name", "link", F.col("article.title").alias("title"), F.col("article.method").alias("method"))


@query("""WITH s AS (SELECT DISTINCT name AS source_name, trim(rss_feed) AS feed_url FROM sources WHERE name IS NOT NULL AND trim(rss_feed) <> ''), i AS (SELECT trim(source_feed_url) AS feed_url, item_no, trim(link) AS link, nullif(trim(title), '') AS title FROM feed_items WHERE trim(link) <> ''),
    j AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY source_name, feed_url || '#' || item_no) AS r FROM i JOIN s USING (feed_url)) SELECT source_name, link, title FROM j WHERE r = 1""")
def feed_poll(s: SparkSession, sf: str) -> DataFrame:
    """Every item as a feed of its own address, so that no feed is put together in one row."""
    items = T(s, sf, "feed_items").select(F.trim("source_feed_url").alias("feed_url"), "item_no", "link", "title").filter("feed_url is not null")
    tag = lambda n, v: F.coalesce(F.concat(F.lit(f"<{n}><![CDATA["), v, F.lit(f"]]></{n}>")), F.lit(""))
    own = F.concat("feed_url", F.lit("#"), F.col("item_no").cast("string"))
    feeds = items.select(own.alias("feed_url"), F.concat(F.lit("<rss><channel><item>"), tag("title", F.col("title")), tag("link", F.col("link")), F.lit("</item></channel></rss>")).alias("xml"))
    named = T(s, sf, "sources").select("name", F.trim("rss_feed").alias("feed"))
    sources = items.select("feed_url", own.alias("rss_feed")).join(named.filter("feed <> ''"), F.col("feed_url") == F.col("feed")).select("name", "rss_feed")
    return pl.poll_feeds(sources, feeds, F.lit(NOW).cast("timestamp")).select("source_name", "link", "title")


@query()
def md_topics(s: SparkSession, sf: str) -> DataFrame:
    return pl.topic_job(_md(s, sf)).select("doc_id", "no", "slug", F.md5("text").alias("text_md5"))


@query()
def md_unified_chunks(s: SparkSession, sf: str) -> DataFrame:
    return pl.chunk_job(_md(s, sf), 300, merge=True).select("document", "id", "topic", "title", F.md5("text").alias("text_md5"))


@query()
def md_packed_chunks(s: SparkSession, sf: str) -> DataFrame:
    return pl.pack_chunks(pl.chunk_job(_md(s, sf), 300)).select("document", "topic", "bin", "name", F.md5("text").alias("text_md5"))


@query()
def md_one_stage_chunks(s: SparkSession, sf: str) -> DataFrame:
    return pl.chunk_records_one_stage(_md(s, sf), 300).select("doc_id", "id", "title", F.md5("text").alias("text_md5"))


@query()
def md_bpe_counts(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "md_sections").select("section_id", bpe.bpe_token_count(F.col("text")).alias("tokens"))


@query(r"SELECT section_id, count(*) AS headings FROM (SELECT section_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM md_sections) WHERE regexp_matches(line, '^#[ 	]+\S') GROUP BY section_id")
def md_top_headings(s: SparkSession, sf: str) -> DataFrame:
    return md.headings_at(_md(s, sf), 1).groupBy(F.col("doc_id").alias("section_id")).agg(F.count(F.lit(1)).alias("headings"))


@query()
def json_css_items(s: SparkSession, sf: str) -> DataFrame:
    schema = {"baseSelector": "li", "fields": [{"name": "title", "selector": "a", "type": "text"}, {"name": "link", "selector": "a", "type": "attribute", "attribute": "href"}]}
    return T(s, sf, "fetch_results").select("page_id", extract.by_json_css(F.col("html"), schema).alias("items")).filter("items is not null")


@query("SELECT name, coalesce(llm_analysis_pending, extraction_selectors IS NULL OR cardinality(extraction_selectors) = 0) AS pending FROM sources")
def sources_to_analyse(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "sources").select("name", flow.needs_analysis(F.col("llm_analysis_pending"), F.col("extraction_selectors")).alias("pending"))


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"user_id\":' || coalesce(CAST(user_id AS VARCHAR), 'null') || ',\"event_type\":' || coalesce('\"' || event_type || '\"', 'null') || '}' AS json FROM events")
def events_as_json(s: SparkSession, sf: str) -> DataFrame:
    return T(s, sf, "events").select("event_id", flow.encode(F.struct("event_id", "user_id", "event_type")).alias("json"))
