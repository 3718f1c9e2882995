"""A small tolerant HTML reader: text stretches with the path of elements they stand in, and selectors.

Loose markup is expected: unclosed paragraphs and list items end where the next one starts, stray end tags are skipped,
attributes may be unquoted, a page may break off anywhere. Scripts, styles, templates and comments give nothing.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "template", "textarea", "title", "iframe", "svg", "math", "object", "select")}
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
SILENT = frozenset("script style template noscript head iframe svg math object select textarea button".split())
_CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SCOPE = {"li": {"ul", "ol", "menu", "div", "td", "body", "article", "section", "main", "aside"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "p": {"div", "td", "li", "body", "article", "section", "main", "aside", "blockquote", "figure", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
SPACE = re.compile(r"\s+")
#: Elements nested deeper than this stand beside each other, as in browsers; no text is lost.
DEEPEST = 300


_NONE: dict[str, str] = {}


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    children: list = field(default_factory=list)  # Node or str
    level: int = 0

    @property
    def style(self) -> str:
        """The presentation of the element: its tag with what names its kind (numbers in names don't)."""
        a = self.attrs
        return style_of(self.tag, a.get("class"), a.get("id"), a.get("role"), a.get("itemprop")) if a else self.tag


@lru_cache(maxsize=100_000)
def style_of(tag: str, classes: str | None, ident: str | None, role: str | None, prop: str | None) -> str:
    name = ".".join(sorted(classes.split())) if classes else ""
    name = ("." if name else "") + name + (f"#{ident}" if ident else "") + (f"[role={role}]" if role else "") + (f"[itemprop={prop}]" if prop else "")
    return tag + re.sub(r"\d+", "0", name)


@lru_cache(maxsize=20_000)
def _attrs(text: str) -> dict[str, str]:
    """Attributes of a tag; the dictionary is shared by equal tags and never changed."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        v = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), html.unescape(v) if "&" in v else v)
    return out


def parse(page: str) -> Node:
    """The page as a tree; every text as it stands, entities not yet resolved."""
    root = node = Node("#root", {}, None)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if m[1]:  # end tag
            tag, up = m[1].lower(), node
            if up.tag == tag and up.parent is not None:
                node = up.parent
                continue
            while up is not root and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:
                    up = root  # an inline end tag never closes a block
                else:
                    up = up.parent
            if up is not root:
                node = up.parent
        elif m[2] or m[4]:
            tag, given = (m[2] or m[4]).lower(), m[3] or m[5]
            attrs = _attrs(given) if given else _NONE
            if tag in _BLOCKS and node.tag == "p" or tag in _BLOCKS and node.tag in INLINE:
                up = node
                while up.tag in INLINE:
                    up = up.parent
                if up.tag == "p":
                    node = up.parent
            if tag in _CLOSES:
                up, stop = node, _SCOPE[tag]
                while up is not root and up.tag not in stop:
                    if up.tag in _CLOSES[tag]:
                        node = up.parent
                        if tag != "tr":
                            break
                    up = up.parent
            new = Node(tag, attrs, node, level=node.level + 1)
            node.children.append(new)
            if tag in _RAW:
                end = _RAW[tag].search(page, at)
                if tag == "title":
                    new.children.append(page[at : end.start() if end else n])
                at = end.end() if end else n
            elif tag not in VOID and new.level < DEEPEST:
                node = new
    return root


def clean(text: str) -> str:
    """Entities resolved, every run of white space one blank, ends trimmed."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


@dataclass(slots=True)
class Stretch:
    """A run of text between block boundaries and line breaks."""

    text: str
    node: Node  # the block element that holds it
    linked: int  # characters inside links
    marked: int  # characters inside b, strong, h*
    breaks: bool  # parted by line breaks
    leads: bool  # begins with a link


def stretches(root: Node, silent: frozenset[str] = SILENT) -> list[Stretch]:
    out: list[Stretch] = []
    buffer: list[str] = []
    state = {"linked": 0, "marked": 0, "leads": False, "any": False}

    def flush(node: Node, by_break: bool = False) -> None:
        text = clean("".join(buffer))
        if text:
            out.append(Stretch(text, node, state["linked"], state["marked"], by_break, state["leads"]))
        buffer.clear()
        state.update(linked=0, marked=0, leads=False, any=False)

    def walk(node: Node, block: Node, linked: bool, marked: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                buffer.append(c)
                k = len(c.strip())
                if k and not state["any"]:
                    state["any"], state["leads"] = True, linked
                if linked:
                    state["linked"] += k
                if marked:
                    state["marked"] += k
            elif c.tag == "br":
                flush(block, True)
            elif c.tag in silent:
                continue
            elif c.tag in INLINE:
                walk(c, block, linked or c.tag == "a", marked or c.tag in ("b", "strong"))
            elif c.tag in VOID:
                if c.tag == "hr":
                    flush(block)
            else:
                flush(block)
                walk(c, c, linked, marked)
                flush(c)

    walk(root, root, False, False)
    flush(root)
    return out


_STEP = re.compile(r"\s*(>)?\s*([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)")


def css_steps(text: str | None) -> list[tuple[bool, str, list[str]]]:
    """A subset of CSS: tag, .class, #id, [attr], [attr=value], descendant and child. Anything else matches nothing."""
    out, at = [], 0
    text = (text or "").strip()
    while at < len(text):
        m = _STEP.match(text, at)
        if not m or m.end() == at or not (m[2] or m[3]):
            return []
        out.append((bool(m[1]), (m[2] or "*").lower(), re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[3])))
        at = m.end()
    return out


def _fits(n: Node, step: tuple[bool, str, list[str]]) -> bool:
    if step[1] not in ("*", n.tag):
        return False
    for t in step[2]:
        if t[0] == "." and t[1:] not in (n.attrs.get("class") or "").split():
            return False
        if t[0] == "#" and n.attrs.get("id") != t[1:]:
            return False
        if t[0] == "[":
            k, _, v = t[1:-1].partition("=")
            if k.strip().lower() not in n.attrs or v and n.attrs[k.strip().lower()] != v.strip("\"' "):
                return False
    return True


def matches(chain: list[Node], steps: list[tuple[bool, str, list[str]]]) -> bool:
    """Whether some element of the chain is selected."""
    return any(_ends_at(chain, steps, i, len(steps) - 1) for i in range(len(chain)))


def ends(chain: list[Node], steps: list[tuple[bool, str, list[str]]]) -> bool:
    """Whether the last element of the chain is selected."""
    return _ends_at(chain, steps, len(chain) - 1, len(steps) - 1)


def _ends_at(chain: list[Node], steps: list[tuple[bool, str, list[str]]], i: int, k: int) -> bool:
    if not _fits(chain[i], steps[k]):
        return False
    if k == 0:
        return True
    if steps[k][0]:
        return i > 0 and _ends_at(chain, steps, i - 1, k - 1)
    return any(_ends_at(chain, steps, j, k - 1) for j in range(i))


def select(root: Node, selector: str | None) -> list[Node]:
    """The elements a selector matches, in document order."""
    steps = css_steps(selector)
    out: list[Node] = []

    def walk(n: Node, chain: list[Node]) -> None:
        for c in n.children:
            if isinstance(c, Node):
                own = [*chain, c]
                if steps and ends(own, steps):
                    out.append(c)
                walk(c, own)

    walk(root, [])
    return out


def text_of(n: Node, joint: str = "") -> str:
    """The visible text of an element, block by block."""
    return joint.join(s.text for s in stretches(n)) if joint else clean(" ".join(s.text for s in stretches(n)))


_HEADED = frozenset("title meta link base style script noscript template".split())
#: Inline elements that may hold a byline or a date and then count as blocks of their own.
_MAY_STAND_ALONE = INLINE - {"a", "b", "i", "em", "strong"}
_NAME = re.compile(r"(?i)(?:^|[.#_-])(?:by(?:line)?|author|writer|meta|dateline|credit|published)(?:$|[.#_\[-])|itemprop=(?:author|date)")


@lru_cache(maxsize=100_000)
def names_byline(style: str) -> bool:
    """Whether the name of an element says that it holds a byline or a date."""
    return _NAME.search(style) is not None


@lru_cache(maxsize=50_000)
def _opened(name: str, given: str | None) -> tuple[str, str, bool]:
    """Tag, style and whether the element stands within a line, of a start tag."""
    tag = name.lower()
    attrs = _attrs(given) if given else _NONE
    style = style_of(tag, attrs.get("class"), attrs.get("id"), attrs.get("role"), attrs.get("itemprop")) if attrs else tag
    inline = tag in INLINE
    if inline and attrs and tag in _MAY_STAND_ALONE and names_byline(style):
        style, inline = "byline" + style[len(tag) :], False
    return tag, style, inline


#: What a link must hold for its style to be more than its tag.
_NAMED_LINK = re.compile(r"(?i)\b(?:class|id|role|itemprop)\s*=")


class Open:
    """An element that is open while a page is read."""

    __slots__ = ("tag", "given", "style", "inline", "path", "nodes", "hint", "up")

    def __init__(self, tag: str, given: str | None, style: str, inline: bool, up: Open | None):
        self.tag, self.given, self.style, self.inline, self.up, self.path = tag, given, style, inline, up, None

    @property
    def attrs(self) -> dict[str, str]:
        return _attrs(self.given) if self.given else _NONE


def read_stretches(page: str, steps: list[tuple[bool, str, list[str]]], silent: frozenset[str] = SILENT) -> list[tuple]:
    """The text stretches of a page in one pass, without building its tree.

    Each is (path of styles, numbers of the elements of that path, text, characters in links, ended by a line break, begins
    with a link, stands in an element that the steps of a selector name).
    """
    out: list[tuple] = []
    root = Open("#root", None, "", False, None)
    root.path, root.nodes, root.hint = "", [], False
    stack, top = [root], root
    buffer: list[str] = []
    links = linked = quiet = number = 0
    leads = any_text = False

    def locate(e: Open) -> None:
        nonlocal number
        if e.tag == "html" or e.tag == "body":
            e.path, e.nodes, e.hint = "", [], False
            return
        up = e.up
        if up.path is None:
            locate(up)
        e.path = f"{up.path}>{e.style}" if up.path else e.style
        e.nodes = [*up.nodes, number]
        number += 1
        e.hint = up.hint or bool(steps) and _fits(e, steps[-1]) and ends(_chain(e), steps)

    def flush(breaks: bool = False) -> None:
        nonlocal linked, leads, any_text
        if any_text:
            text = " ".join(buffer[0].split() if len(buffer) == 1 else "".join(buffer).split())
            if "&" in text:
                text = " ".join(html.unescape(text).split())
            if text:
                e = top
                while e.inline:
                    e = e.up
                if e.path is None:
                    locate(e)
                out.append((e.path, e.nodes, text, linked, breaks, leads, e.hint))
            linked, leads, any_text = 0, False, False
        buffer.clear()

    def close(n: int) -> None:
        """Ends the elements from place n of the stack on."""
        nonlocal top, links, quiet
        while len(stack) > n:
            if top.tag in silent:
                quiet -= 1
            elif not quiet and not top.inline:
                flush()
            if top.tag == "a":
                links -= 1
            stack.pop()
            top = stack[-1]

    at, size, tokens = 0, len(page), _TOKEN.finditer(page)
    while True:
        m = next(tokens, None)
        start = m.start() if m is not None else size
        if start > at and not quiet:
            text = page[at:start]
            buffer.append(text)
            if not text.isspace():
                if not any_text:
                    any_text, leads = True, links > 0
                if links:
                    linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        end, name, given, loose, rest = m.groups()
        if end:
            tag = end.lower()
            if top.tag == tag:
                close(len(stack) - 1)
                continue
            inline = tag in INLINE
            for k in range(len(stack) - 1, 0, -1):
                e = stack[k]
                if e.tag == tag:
                    close(k)
                    break
                if inline and e.tag not in INLINE:
                    break
            continue
        if not (name or loose):
            continue
        given = given or rest or None
        if (name == "a" or name == "A") and not (given and _NAMED_LINK.search(given)):
            tag, style, inline = "a", "a", True  # most links have an address of their own; they are not worth remembering
        else:
            tag, style, inline = _opened(name or loose, given)
        if top.tag == "head" and tag not in _HEADED:
            close(len(stack) - 1)
        if tag in _BLOCKS and (top.tag == "p" or top.tag in INLINE):
            k = len(stack) - 1
            while stack[k].tag in INLINE:
                k -= 1
            if stack[k].tag == "p":
                close(k)
        if tag in _CLOSES:
            k, stop, ended = len(stack) - 1, _SCOPE[tag], 0
            while k > 0 and stack[k].tag not in stop:
                if stack[k].tag in _CLOSES[tag]:
                    ended = k
                    if tag != "tr":
                        break
                k -= 1
            if ended:
                close(ended)
        if tag in _RAW:
            found = _RAW[tag].search(page, at)
            if tag == "title" and not quiet:
                flush()
                stack.append(Open(tag, given, style, False, top))
                top = stack[-1]
                buffer.append(page[at : found.start() if found else size])
                any_text = True
                close(len(stack) - 1)
            at = found.end() if found else size
            tokens = _TOKEN.finditer(page, at)
        elif tag in VOID:
            if not quiet and (tag == "br" or tag == "hr"):
                flush(tag == "br")
        elif len(stack) <= DEEPEST:
            if tag in silent:
                quiet += 1
            elif not inline and not quiet:
                flush()
            top = Open(tag, given, style, inline, top)
            stack.append(top)
            if tag == "a":
                links += 1
        elif not inline and not quiet and tag not in silent:
            flush()
    close(1)
    flush()
    return out


def _chain(e: Open) -> list[Open]:
    out = []
    while e.up is not None:
        if e.tag not in ("html", "body"):
            out.append(e)
        e = e.up
    return out[::-1]
