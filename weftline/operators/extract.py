"""Articles out of HTML by structured data, selectors and a general reading, as a cascade; discovery of feeds and classes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import resolve

ARTICLE = "struct<title:string,text:string,published:string,authors:array<string>,method:string>"
_LD = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
_ITEM = "`@type` string, headline string, name string, title string, articleBody string, text string, datePublished string, dateModified string, author string"
_ITEMS = f"array<struct<{_ITEM.replace(' string', ':string')},`@graph`:array<struct<{_ITEM.replace(' string', ':string')}>>>>"


def plain(html: Column) -> Column:
    """Visible text of a fragment: scripts, comments and tags dropped, the common entities resolved, blanks squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(?:script|style)>|<!--.*?-->|<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def page_title(html: Column) -> Column:
    return F.nullif(plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def page_heading(html: Column) -> Column:
    return F.nullif(plain(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))


def feed_links(html: Column, base: Column | None = None) -> Column:
    """Feed addresses of the head, in whatever order rel, type and href stand, distinct; resolved if a base is given."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))
    feeds = F.filter(tags, lambda t: t.rlike("(?i)\\stype\\s*=\\s*[\"']?application/rss\\+xml") & t.rlike("(?i)\\srel\\s*=\\s*(?:[\"'][^\"']*\\balternate\\b|alternate)"))
    found = F.transform(feeds, lambda t: F.replace(F.regexp_replace(F.regexp_extract(t, r"""(?i)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), "[\"']", ""), F.lit("&amp;"), F.lit("&")))
    found = F.filter(found, lambda h: h != "")
    return F.array_distinct(F.transform(found, lambda h: resolve(base, h)) if base is not None else found)


def authors(value: Column) -> Column:
    """Names of a text (parted by commas), a JSON name object or a JSON list of either; blanks go."""
    named = F.transform(F.regexp_extract_all(value, F.lit(r'"name"\s*:\s*"([^"]*)"'), F.lit(1)), lambda x: F.trim(x))
    listed = F.transform(F.regexp_extract_all(value, F.lit(r'"([^"]*)"'), F.lit(1)), lambda x: F.trim(x))
    said = F.transform(F.split(value, ","), lambda x: F.trim(x))
    return F.coalesce(F.filter(F.when(value.rlike(r"^\s*[\[{]") & (F.size(named) > 0), named).when(value.rlike(r"^\s*\["), listed).otherwise(said), lambda x: x != ""), F.array().cast("array<string>"))


def normalized(title: list[Column], text: list[Column], date: list[Column], author: Column, method: Column) -> Column:
    """The first non-empty of the candidates for each field, trimmed."""
    first = lambda cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    return F.struct(F.trim(first(title)).alias("title"), F.trim(first(text)).alias("text"), first(date).alias("published"), authors(author).alias("authors"), method.alias("method"))


def is_article_type(kind: Column) -> Column:
    """Whether a type (or the list of types, as JSON) names an article; only the first of a list counts."""
    return F.coalesce(F.lower(_first_type(kind)).rlike("article|blogposting|webpage"), F.lit(False))


def _first_type(kind: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(kind, r"^\s*\[?\s*\"?([^\",\]]+)", 1), r"^https?://schema\.org/", "")


def by_schema(html: Column) -> Column:
    """From JSON-LD: the first item of an article-like type with a title (headline or name) or a text.

    A block may hold one item, a list of items, or a graph of them.
    """
    blocks = F.transform(F.regexp_extract_all(html, F.lit(_LD), F.lit(1)), lambda b: F.from_json(b, _ITEMS))
    fields = [f.strip("`") for f in _ITEM.replace(" string", "").split(", ")]
    plain_ = lambda i: F.struct(*[i[f].alias(f) for f in fields])
    with_graph = lambda i: F.concat(F.array(plain_(i)), F.coalesce(i["@graph"], F.array().cast(f"array<struct<{_ITEM.replace(' string', ':string')}>>")))
    items = F.flatten(F.transform(F.flatten(F.filter(blocks, lambda b: b.isNotNull())), with_graph))
    items = F.filter(items, lambda i: is_article_type(i["@type"]) & F.coalesce(i["headline"], i["name"], i["title"], i["articleBody"], i["text"]).isNotNull())
    i = F.try_element_at(items, F.lit(1))
    return F.when(i.isNotNull(), normalized([i["title"], i["headline"], i["name"]], [i["text"], i["articleBody"]], [i["datePublished"], i["dateModified"]], i["author"], F.concat(F.lit("schema_org_"), F.lower(_first_type(i["@type"])))))


def by_microdata(html: Column) -> Column:
    """From microdata (ARTICLE): the first element of an article-like type with a title or a text; null without one."""
    from weftline.functions.html import parse, text_of

    def one(page: str | None) -> tuple | None:
        if not page:
            return None
        todo = [parse(page)]
        while todo:
            n = todo.pop()
            kind = (n.attrs.get("itemtype") or "").split(" ")[0].rstrip("/").rpartition("/")[2].lower()
            if "itemscope" in n.attrs and re.search("article|blogposting|webpage", kind):
                got = _properties(n)
                said = lambda *names: next((x for k in names for e in got.get(k, ())[:1] if (x := (e.attrs.get("content") or e.attrs.get("datetime") or text_of(e, "\n")).strip())), None)  # noqa: E731, B023
                title, text = said("headline", "name"), said("text", "articleBody")
                if title or text:
                    who = [(e.attrs.get("content") or text_of(e)).strip() for e in got.get("author", ())]
                    return (title, text, said("datePublished", "dateModified"), [w for w in who if w], f"schema_org_{kind}")
            todo += [c for c in reversed(n.children) if not isinstance(c, str)]
        return None

    @F.pandas_udf("title string, text string, published string, authors array<string>, method string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            yield pd.DataFrame([one(p) or (None, None, None, None, None) for p in pages], columns=["title", "text", "published", "authors", "method"])

    return run(html)


def _properties(scope) -> dict[str, list]:
    """The elements of a scope by their itemprop, in order; those of scopes within it belong to these, but for names of persons."""
    out: dict[str, list] = {}
    todo = list(reversed([c for c in scope.children if not isinstance(c, str)]))
    while todo:
        n = todo.pop()
        for k in (n.attrs.get("itemprop") or "").split():
            out.setdefault(k, []).append(n)
        if "itemscope" not in n.attrs:
            todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    return out


def by_json_css(html: Column, schema: dict) -> Column:
    """JSON list of the items that a schema {baseSelector, fields: [{name, selector, type, attribute, default, fields}]} finds.

    Types: text, attribute, html (as text), nested (one object), list and nested_list (lists of objects). A field without a match
    has its default or is left out; null for null pages; an item without any field is no item.
    """
    from weftline.functions.html import parse, select, text_of

    def value(n, field: dict):
        if field.get("type") == "attribute":
            return n.attrs.get(field.get("attribute", ""), field.get("default"))
        if field.get("type") in ("nested", "list", "nested_list"):
            return item(n, field.get("fields", []))
        return text_of(n) or field.get("default")

    def item(n, fields: list[dict]) -> dict:
        got = {}
        for f in fields:
            found = select(n, f["selector"]) if f.get("selector") else [n]
            v = [value(x, f) for x in found] if f.get("type") in ("list", "nested_list") else value(found[0], f) if found else f.get("default")
            if v is not None and v != []:
                got[f["name"]] = v
        return got

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        out = [None if p is None else json.dumps([x for n in select(parse(p), schema["baseSelector"]) if (x := item(n, schema.get("fields", [])))], ensure_ascii=False) for p in pages]
        return pd.Series(out, dtype=object)

    return run(html)


def by_selectors(html: Column, selectors: Column) -> Column:
    """From configured selectors (ARTICLE): first title, all texts parted by line ends, all authors, first date (its datetime
    attribute, else its text); null where nothing matches. Supported: tag, .class, #id, [attr], [attr=value], descendant, >."""
    from weftline.functions.html import parse, select, text_of

    def one(page: str | None, given: dict | None) -> tuple | None:
        s = {k: v for k, v in dict(given or {}).items() if v and v.strip()}
        if not page or not s:
            return None
        root = parse(page)
        find = lambda k: select(root, s.get(f"article_{k}_selector"))
        title, text, date, author = find("title"), find("content"), find("date"), find("author")
        if not (title or text or date or author):
            return None
        when = (date[0].attrs.get("datetime") or text_of(date[0])) if date else None
        return (text_of(title[0]) if title else None, "\n".join(text_of(n, "\n") for n in text) if text else None, when, [text_of(a) for a in author], "custom_css")

    @F.pandas_udf("title string, text string, published string, authors array<string>, method string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, maps in batches:
            yield pd.DataFrame([one(p, m) or (None, None, None, None, None) for p, m in zip(pages, maps, strict=True)], columns=["title", "text", "published", "authors", "method"])

    return run(html, selectors)


def by_general(html: Column) -> Column:
    """From the title and the visible text of article, main or body."""
    region = F.coalesce(*[F.nullif(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*)</{t}>", 1), F.lit("")) for t in ("article", "main", "body")], html)
    meta = lambda n: F.nullif(F.regexp_extract(html, rf"(?i)<meta[^>]*(?:name|property)=[\"']{n}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1), F.lit(""))
    return normalized([page_title(html), page_heading(html)], [plain(region)], [meta("article:published_time"), meta("date")], meta("author"), F.lit("general"))


def cascade(pages: DataFrame, selectors: str | None = None) -> DataFrame:
    """page_id and article (ARTICLE): structured data (JSON-LD, then microdata) if it has title and text, else the configured
    selectors (column selectors) if they give both, else the general reading, which counts as partial if it lacks one; pages
    without html give the method no_data_found. Pages that JSON-LD settles never reach Python."""
    enough = lambda a: F.coalesce((F.coalesce(a["title"], F.lit("")) != "") & (F.coalesce(a["text"], F.lit("")) != ""), F.lit(False))
    p = pages.withColumn("__s", by_schema(F.col("html")))
    open_ = F.when(~enough(F.col("__s")), F.col("html"))
    p = p.withColumn("__m", by_microdata(F.when(F.contains(F.lower("html"), F.lit("itemscope")), open_)))
    general = by_general(F.col("html"))
    none = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("published"), F.array().cast("array<string>").alias("authors"), F.lit("no_data_found").alias("method"))
    if selectors:
        p = p.withColumn("__c", by_selectors(F.when(~enough(F.col("__m")), open_), F.col(selectors)))
        general = F.when(enough(F.col("__c")), F.col("__c")).otherwise(general)
    chosen = F.when(F.col("html").isNull() | (F.col("html") == ""), none).when(enough(F.col("__s")), F.col("__s")).when(enough(F.col("__m")), F.col("__m")).otherwise(general)
    return p.select("page_id", chosen.alias("article"))


def main_region(html: Column) -> Column:
    """What stands in the main element; null without one."""
    return F.when(html.rlike(r"(?i)<main\b"), F.regexp_replace(F.regexp_replace(html, r"(?is)^.*?<main\b[^>]*>", ""), r"(?is)</main\s*>.*$", ""))


def recurrent_class(pages: DataFrame, least: int = 2) -> DataFrame:
    """page_id, css_class, n, sample: the class that most div elements in a page's main element carry (the first to appear on
    ties), if at least two do, and the first of these elements with what it holds. Pages without a main element have no row."""
    found = F.regexp_extract_all(main_region(F.col("html")), F.lit(r"(?i)<div\s(?:[^>]*?\s)?class\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), F.lit(1))
    classes = F.flatten(F.transform(found, lambda c: F.split(F.trim(F.regexp_replace(c, "[\"']", "")), r"\s+")))
    p = pages.filter(F.col("html").rlike(r"(?i)<main\b")).select("page_id", "html", classes.alias("__all"))
    counted = F.transform(F.array_distinct(F.filter("__all", lambda c: c != "")), lambda c, i: F.struct((-F.size(F.filter("__all", lambda x: x == c))).alias("n"), i.alias("first"), c.alias("css_class")))
    # The generator keeps the choice apart from the UDF that takes it.
    p = p.select("page_id", "html", F.explode(F.array(F.array_min(counted))).alias("__b")).filter(-F.col("__b")["n"] >= least)
    return p.select("page_id", F.col("__b")["css_class"].alias("css_class"), (-F.col("__b")["n"]).cast("bigint").alias("n"), first_div(main_region(F.col("html")), F.col("__b")["css_class"]).alias("sample"))


def first_div(html: Column, css_class: Column) -> Column:
    """The first div of a class with all that it holds, as it is written; null without one."""

    def one(page: str | None, name: str | None) -> str | None:
        if page is None or name is None:
            return None
        begin, depth = None, 0
        for m in re.finditer(r"(?is)<(/?)div\b([^>]*)>", page):
            if begin is None:
                given = re.search(r"(?i)\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", m[2])
                if m[1] or not given or name not in (given[1] or given[2] or given[3] or "").split():
                    continue
                begin = m.start()
            depth += -1 if m[1] else 1
            if depth == 0:
                return page[begin : m.end()]
        return None if begin is None else page[begin:]

    @F.pandas_udf("string")
    def run(pages: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([one(p, c) for p, c in zip(pages, names, strict=True)], dtype=object)

    return run(html, css_class)
