"""The article itself out of web pages, by site style trees.

1. Every page is read once into text stretches with their paths of elements (their presentation).
2. The pages of a host are merged into one style tree: per node the contents of all pages are counted and the node's
   importance is the normalised entropy of those contents, near 0 where all pages show the same and 1 where every page
   shows something else. The same counts over all hosts, by the kind of node that the end of its path names, also tell of nodes
   that a host shows too rarely. A content counts once per article: pages fetched again, or given under other addresses,
   don't make it look like boilerplate.
3. On each page branches of low importance go, and so do those that are mostly links; of what is left the container nearest
   to the headline with the most text is the article, with the containers of its own make beside it. The configured selector
   raises the weight of what it matches, no more, as it may be missing or wrong.

Nodes and contents travel as 64-bit hashes. Counting is partial before it is shuffled, so a host with a third of all pages is
no hot spot. Only the nodes of low importance are needed afterwards; up to LOW_ROWS of them are broadcast, beyond that the
nodes of every page meet them in a join.
"""

from __future__ import annotations

import marshal
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from weftline.functions.html import SILENT, css_steps, names_byline, read_stretches
from weftline.session import through_table

#: Nodes of low importance (8 bytes each) up to which they are broadcast.
LOW_ROWS = 1_000_000
#: Branches below this importance are noise; nodes seen less often than SEEN on their host are judged over all hosts.
LEAST_IMPORTANCE, SEEN = 0.62, 12
#: Stretches with LINKED of their characters in links are links; ones that begin with a link and hold LEAD of them in links
#: are teasers, and containers with TEASERS of their stretches being either are lists of links.
LINKED, LEAD, TEASERS = 0.62, 0.2, 0.4
#: How many of a page's longest stretches tell whether it is the same article again.
LONGEST = 5

#: A page that was read: hashes of the node of every stretch, of its kinds and of its content, for the style tree; mark, one of
#: 64 numbers drawn from the article; the stretches packed for choose.
READ = "page_id bigint, host string, page_hash bigint, mark tinyint, nodes array<bigint>, kinds array<bigint>, lasts array<bigint>, contents array<bigint>, packed binary"
PARTS = "page_id bigint, no int, part string, tag string, text string"

_PLAIN = frozenset("p ul ol li dl dt dd blockquote q pre h2 h3 h4 h5 h6 center".split())
_NOISE_TAGS = frozenset("nav header footer aside figure figcaption form menu button dialog small".split())
_HEAD = frozenset("h1 title".split())
# What the names of reader comments hold.
_COMMENTS = re.compile(r"(?i)(?:^|[.#_-])(?:comments?|cm|discussion|replies|respond|disqus)(?:$|[.#_\[-])")
_SENTENCE = re.compile(r"[.!?…:;。！？][\"'”’»“„)\]]*$")


_NUMBER = re.compile(r"\d[\d.,]*")


def fold(text: str) -> str:
    return _NUMBER.sub("0", text.lower())


def read_page(page: str, selector: str | None) -> list[tuple]:
    """The text stretches of a page in order, as (path, element numbers, text, linked, breaks, leads, hint)."""
    steps = css_steps(selector)
    # A page of scripts alone: what it shows without them.
    return read_stretches(page, steps) or read_stretches(page, steps, SILENT - {"noscript"})


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def article_mark(rows: list[tuple], contents: list[int]) -> int:
    """One of 64 numbers for the article of a page, the same where the page is fetched again or given elsewhere."""
    own = sorted(range(len(rows)), key=lambda i: (2 * rows[i][3] > len(rows[i][2]), -len(rows[i][2])))[:LONGEST]
    return _digest(",".join(map(str, sorted(contents[i] for i in own)))) & 63


def read_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """READ of every page with text; the selector is that of the page's source (the least, if it is given twice)."""
    hints = sources.filter("name is not null and extraction_selectors is not null").groupBy(F.col("name").alias("source_name")).agg(F.min(F.col("extraction_selectors")["article_content_selector"]).alias("__selector"))
    p = pages.filter("page_id is not null and html is not null and html <> ''").select("page_id", "url", "html", "source_name")
    if sources.limit(100_001).count() <= 100_000:
        hints = F.broadcast(hints)

    schema = to_arrow_schema(_parse_datatype_string(READ))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                cols: list[list] = [[] for _ in schema]
                for page_id, url, page, selector in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "__selector")), strict=True):
                    rows, host = read_page(page, selector), _host(url)
                    contents = [_digest(fold(r[2])) for r in rows]
                    at = [entries(host, r[0]) for r in rows]
                    for c, v in zip(cols, (page_id, host, _digest(f"{host}\n{page}"), article_mark(rows, contents), *([e[i] for e in at] for i in range(3)), contents, marshal.dumps(rows)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return p.join(hints, "source_name", "left").select("page_id", "url", "html", "__selector").mapInArrow(read, READ)


def _host(url: str | None) -> str:
    try:
        return re.sub(r"^(?:www|m|mobile|amp)\.", "", (urlsplit(url or "").hostname or "").lower())
    except ValueError:
        return ""


#: The end of a path from its nearest element with a name or a meaning on, which names a kind of node on any host.
KIND = r"(?:^|>)((?:(?:[^>]*[.#\[][^>]*|article|main|nav|header|footer|aside|section|td)>)?(?:[a-z]+[1-6]?>)*[^>]+)$"
_KIND = re.compile(KIND)
_NAMED = re.compile(r"[.#\[]")


@lru_cache(maxsize=200_000)
def kind(path: str) -> str:
    m = _KIND.search(path)
    return m[1] if m else path


@lru_cache(maxsize=200_000)
def entries(host: str, path: str) -> tuple[int | None, int | None, int | None]:
    """The entries of the style tree that vote on a node: the node on its host, its kind on all hosts, and its last element.

    A last element without a name, as the p of all paragraphs, is no kind of its own; nor is text outside all elements a node.
    """
    if not path:
        return None, None, None
    own, last = kind(path), path.rpartition(">")[2]
    return _digest(f"{host}\n{path}"), _digest(own), _digest(last) if last != own and _NAMED.search(last) else None


def style_tree(read: DataFrame) -> DataFrame:
    """entry, seen, importance of every entry of the merged pages, see entries.

    How many articles show a content is estimated from their marks by linear counting up to about 200, and is the number of
    pages beyond; so an article that is fetched any number of times counts once.
    """
    each = read.select("mark", F.inline(F.arrays_zip("nodes", "kinds", "lasts", "contents"))).select("mark", F.col("contents").alias("content"), F.explode(F.array("nodes", "kinds", "lasts")).alias("entry"))
    one = each.filter("entry is not null").groupBy("entry", "content").agg(F.count(F.lit(1)).alias("rows"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, mark)"))).alias("marks"))
    pages = F.when((F.col("rows") == 1) | (F.col("marks") > 61), F.col("rows")).otherwise(F.least(F.col("rows"), F.round(-64 * F.log(1 - F.col("marks") / 64))))
    tree = one.select("entry", pages.cast("double").alias("c")).groupBy("entry").agg(F.sum("c").alias("seen"), F.sum(F.col("c") * F.log("c")).alias("repeats"))
    return tree.filter("seen > 1").select("entry", "seen", (1 - F.col("repeats") / (F.col("seen") * F.log("seen"))).alias("importance"))


@lru_cache(maxsize=200_000)
def _facts(path: str) -> tuple[list[str], list[str], bool, bool, bool]:
    """Styles and tags of a path; whether it runs through noise or comments; whether it ends at a byline."""
    styles = path.split(">") if path else []
    tags = [re.split(r"[.#\[]", x, maxsplit=1)[0] for x in styles]
    byline = "byline" in tags or bool(styles) and names_byline(styles[-1])
    return styles, tags, any(t in _NOISE_TAGS for t in tags), any(_COMMENTS.search(x) for x in styles), byline


def choose(rows: list[tuple], low: list[bool]) -> list[tuple[str, str, str]]:
    """(part, tag, text) of headline, bylines and article blocks of one page; low tells which stretches are of low importance.

    A page with neither headline nor blocks gives all of its text as rest. A page with a headline whose nearest text was
    pruned gives that text as rest, as notices in place of an article repeat from page to page as menus do.
    """
    head = next((i for i, r in enumerate(rows) if r[0].rpartition(">")[2].startswith("h1")), None)
    facts = [_facts(r[0]) for r in rows]
    styles, tags = [f[0] for f in facts], [f[1] for f in facts]
    if head is None:
        head = next((i for i, t in enumerate(tags) if t and t[-1] == "h2" and not facts[i][2]), None)
    out: list[tuple[str, str, str]] = []
    if head is not None:
        out.append(("headline", tags[head][-1], rows[head][2]))
    # Links and teasers per element, to tell lists of links from text with links.
    size: dict[int, int] = {}
    links: dict[int, int] = {}
    teaser = [r[3] >= LINKED * len(r[2]) or r[5] and r[3] >= LEAD * len(r[2]) for r in rows]
    for i, r in enumerate(rows):
        if low[i] or facts[i][2]:
            continue
        for n in r[1]:
            size[n] = size.get(n, 0) + 1
            links[n] = links.get(n, 0) + teaser[i]
    repeated: dict[tuple[int, str], int] = {}
    direct: dict[int, int] = {}
    for r, st in zip(rows, styles, strict=True):
        if r[1]:
            direct[r[1][-1]] = direct.get(r[1][-1], 0) + 1
            up = r[1][-2] if len(r[1]) > 1 else -1
            repeated[up, st[-1]] = repeated.get((up, st[-1]), 0) + 1
    above = rows[head][1] if head is not None else []
    scores: dict[int, float] = {}
    depth: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    chain: dict[int, tuple[list[int], list[str]]] = {}
    pruned: list[tuple[int, int]] = []
    for i, r in enumerate(rows):
        if i == head or not r[2]:
            continue
        t, st, nodes = tags[i], styles[i], r[1]
        if t and (t[-1] in _HEAD or t[-1] == "title"):
            continue
        _, _, noise, comments, byline = facts[i]
        if byline and len(r[2]) < 120:
            if head is not None and not noise and not comments:
                out.append(("byline", "byline", r[2]))
            continue
        if noise or comments:
            continue
        if r[3] >= LINKED * len(r[2]):
            continue
        if low[i] or head is not None and i < head:
            near = _shared(above, nodes)
            if head is not None and not teaser[i] and (i > head or near >= max(1, len(above) - 1)):
                pruned.append((near, i))
        if low[i]:
            continue
        # The container: the nearest element that is no paragraph, list or the like.
        k = len(nodes) - 1
        while k >= 0 and (t[k] in _PLAIN or t[k] == "div" and k == len(nodes) - 1 and direct[nodes[k]] == 1 and not r[4] and k > 0 and repeated.get((nodes[k - 1], st[k]), 0) > 1):
            k -= 1
        c = nodes[k] if k >= 0 else -1
        if c >= 0 and any(links[n] >= TEASERS * size[n] for n in nodes[: k + 1] if n not in above):
            continue
        if head is not None and i < head:
            continue
        held.setdefault(c, []).append(i)
        weight = len(r[2]) * (1.5 if r[6] else 1.0) * (1.0 if _SENTENCE.search(r[2]) else 0.3)
        scores[c] = scores.get(c, 0) + weight
        depth[c] = _shared(above, nodes[: k + 1])
        chain[c] = nodes[: k + 1], st[: k + 1]
    near = max(depth.values(), default=-1)
    if scores:
        best = max((c for c in scores if depth[c] == near), key=lambda c: (scores[c], -c))
        for i in sorted(i for c in held if c == best or _belongs(*chain[c], *chain[best]) for i in held[c]):
            out.append(("block", tags[i][-1] if tags[i] else "", rows[i][2]))
    elif head is None:
        out += [("rest", tags[i][-1] if tags[i] else "", r[2]) for i, r in enumerate(rows) if r[2]]
    out += [("rest", tags[i][-1] if tags[i] else "", rows[i][2]) for shared, i in pruned if shared > near]
    return out


def _belongs(nodes: list[int], styles: list[str], best: list[int], made: list[str]) -> bool:
    """Whether a container is part of the article that has its best one: beside it and made alike, or in it without a name."""
    n = len(best)
    if len(nodes) == n:
        return n > 1 and nodes[:-1] == best[:-1] and styles == made
    return n > 0 and nodes[:n] == best and not any(_NAMED.search(x) for x in styles[n:])


def _shared(above: list[int], nodes: list[int]) -> int:
    """How many outer elements two stretches have in common."""
    n = 0
    for a, b in zip(above, nodes, strict=False):
        if a != b:
            break
        n += 1
    return n


def article_parts(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """PARTS: headline, bylines and article blocks of every page that has any, in order (else all its text as rest).

    Pages with null or empty html and null page_id give nothing; a page given twice gives its rows twice. Texts are whole.
    """
    read = through_table(read_pages(pages, sources), "stretches")
    low = through_table(style_tree(read).filter((F.col("seen") >= SEEN) & (F.col("importance") < LEAST_IMPORTANCE)).select("entry"), "style-tree")
    if low.limit(LOW_ROWS + 1).count() <= LOW_ROWS:
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(low.toArrow().column("entry").to_numpy()))
        told = read.select("page_id", "host", "packed", F.lit(None).cast("array<bigint>").alias("__low"))
    else:
        shared = None
        used = read.select("page_hash", F.explode(F.array_distinct(F.concat("nodes", "kinds", "lasts"))).alias("entry")).distinct()
        hits = used.join(low, "entry", "left_semi").groupBy("page_hash").agg(F.collect_list("entry").alias("__low"))
        told = read.join(hits, "page_hash", "left").select("page_id", "host", "packed", F.coalesce("__low", F.array().cast("array<bigint>")).alias("__low"))

    schema = to_arrow_schema(_parse_datatype_string(PARTS))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], bool] = {}
        sorted_low = None if shared is None else shared.value
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                out: list[tuple] = []
                for page, host, packed, own in zip(*(part.column(c).to_pylist() for c in ("page_id", "host", "packed", "__low")), strict=True):
                    rows = marshal.loads(packed)
                    if sorted_low is None:
                        held = set(own)
                        low = [any(e in held for e in entries(host, r[0])) for r in rows]
                    else:
                        low = []
                        for r in rows:
                            if (is_low := known.get((host, r[0]))) is None:
                                if len(known) > 200_000:
                                    known.clear()
                                is_low = known[host, r[0]] = _is_in(sorted_low, entries(host, r[0]))
                            low.append(is_low)
                    out += [(page, no, *x) for no, x in enumerate(choose(rows, low))]
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return told.mapInArrow(pick, PARTS)


def _is_in(values: np.ndarray, own: tuple[int | None, ...]) -> bool:
    for e in own:
        if e is not None and (at := int(np.searchsorted(values, e))) < len(values) and values[at] == e:
            return True
    return False


def block_hashes(parts: DataFrame, residue: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """page_id, para_md5: the distinct article blocks of the pages that are not among residue(parts)."""
    blocks = parts.filter("part = 'block'").select("page_id", F.md5("text").alias("para_md5"))
    return blocks.join(residue(parts), "page_id", "left_anti").distinct()


def articles(parts: DataFrame) -> DataFrame:
    """page_id, title, text, blocks: the article of each page, its blocks joined by blank lines in their order."""
    own = parts.filter("part in ('block', 'headline')")
    title = F.min(F.when(F.col("part") == "headline", F.col("text"))).alias("title")
    blocks = F.array_sort(F.collect_list(F.when(F.col("part") == "block", F.struct("no", "text"))))
    return own.groupBy("page_id").agg(title, F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n").alias("text"), F.count_if(F.col("part") == "block").alias("blocks"))
