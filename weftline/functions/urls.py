"""URL and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that raise a link's score, and patterns that exclude a link.
LINK_KEYWORDS = "news article story post blog report update analysis breaking latest headline summary release bulletin journal chronicle review insight 2023 2024 jan feb mar apr may jun jul aug sep oct nov dec".split()
EXCLUDED = r"/login|/signin|/register|/signup|/tag/|/user/|/profile/|/account/|/search|/privacy|/terms|/contact|/about|/\?replytocom=|/wp-json/|/feed/$|/comments/feed/$|\.pdf$|\.zip$|\.jpg$|\.jpeg$|\.png$|\.gif$|\.css$|\.js$|archive\.org/web/"


def authority(url: Column) -> Column:
    """Host with port and user info, as written; null for relative and broken URLs."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def origin(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments carried out, as a fold over its segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    ends = F.element_at(parts, -1).isin(".", "..")
    joined = F.concat(F.array_join(kept, "/"), F.when(ends, "/").otherwise(""))
    return F.when(F.contains(path, F.lit("/.")) | path.startswith("."), F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """RFC 3986 resolution of a reference against an absolute http address, within the JVM; fragments stay.

    Line ends and tabs within a reference and blanks around it go. An address with a scheme stays as it is. Null for null; a relative reference without an absolute base stays relative.
    """
    href = F.trim(F.regexp_replace(href, r"[\t\r\n]", ""))
    scheme = F.coalesce(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.lit(""))
    root = F.coalesce(origin(base), F.lit(""))
    base_path = F.regexp_replace(F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    path, rest = F.regexp_replace(href, r"[?#].*$", ""), F.regexp_extract(href, r"^[^?#]*([?#].*)$", 1)
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    merged = F.concat(F.when(folder == "", "/").otherwise(folder), path)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(root == "", href)
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(path == "", F.concat(root, base_path, rest))
        .when(path.startswith("/"), F.concat(root, _without_dots(path), rest))
        .otherwise(F.concat(root, _without_dots(merged), rest))
    )


def is_web_link(href: Column, resolved: Column) -> Column:
    """Not a script, mail or page-internal reference, and absolute once resolved."""
    return ~href.rlike(r"^(javascript:|mailto:|#)") & authority(resolved).isNotNull()


def is_excluded(url: Column) -> Column:
    return url.rlike(EXCLUDED)


def path_depth(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def link_score(url: Column, optimal_depth: int = 3) -> Column:
    """Mean of the weighted keyword share (0.6) and depth fitness (0.4)."""
    low = F.lower(url)
    matched = sum((F.contains(low, F.lit(k)).cast("int") for k in LINK_KEYWORDS), F.lit(0))
    return F.round((0.6 * (matched / F.lit(float(len(LINK_KEYWORDS)))) + 0.4 * (1.0 / (1.0 + F.abs(path_depth(url) - optimal_depth)))) / 2.0, 9)


def sanitize_filename(name: Column) -> Column:
    """A file name for a URL or title; 'untitled' for null and empty."""
    bare = F.regexp_replace(name, r"^https?://", "")
    safe = F.regexp_replace(F.regexp_replace(bare, r'[/:?*"<>|]', "_"), r"[^\p{L}\p{N}_.\-]", "_")
    return F.when(F.coalesce(name, F.lit("")) == "", "untitled").otherwise(F.left(safe, F.lit(150)))


def sitemap_title(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.concat(F.lit("Sitemap: "), F.substring_index(path, "/", -1))


def pick_agent(url: Column, agents: list[str]) -> Column:
    """One of the user agents, always the same for a URL."""
    return F.element_at(F.array(*map(F.lit, agents)), F.pmod(F.hash(url), F.lit(len(agents))) + 1)
