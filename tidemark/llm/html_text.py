"""HTML pages as trees of blocks, and the tokens that templates are deduced from."""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import xxhash

#: Fixed values of HTML: tags that make blocks, that have no content, whose content is raw, and that close an open tag of the same list.
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 header footer nav aside ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset legend details summary address center menu dialog hgroup search".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table div article section main body html aside nav header footer".split())

#: What isn't the article by its tag, by its role, and by the head word of its class or id.
OTHER_TAGS = set("head nav footer aside form button select option textarea script style noscript template iframe svg math canvas object embed audio video map dialog menu search fieldset label title xmp noembed noframes".split())
#: Of those, what may still hold text that a reader sees.
SEEN = set("nav footer aside form menu search fieldset".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist tooltip status".split())
COMMENTS = set("comment comments commentlist commentarea reply replies respond disqus".split())
AUDIENCE = set("reader readers feedback".split())
READERS = COMMENTS | AUDIENCE | set("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted promotion promotions".split())
CHROME = READERS | set(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars sidenav aside widget widgets footer foot colophon header masthead topbar banner cookie cookies consent gdpr notice notices "
    "disclaimer popup modal overlay newsletter subscribe subscription signup signin login register share sharing sharebar social related recommended recommendation recommendations trending popular pagination pager "
    "paginator skip skiplink toolbar search searchbox form tags taglist copyright".split()
)
WRAPPERS = {"has", "with", "no", "without", "is"}
#: Words that may follow the head word, head words that an article has itself, and what marks them as an article's.
SUFFIXES = set("area bar block box button buttons container icons inner item items left link links list message post posts right section slot text unit widget widgets wrap wrapper".split())
EDGES = set("header masthead footer foot colophon".split())
OWNERS = set("article entry post story content".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


NO_NAMES: frozenset[str] = frozenset()
#: What an inline tag must mention to be looked at.
TELLING = re.compile(r"class|id|role|hidden|style", re.I)


@functools.lru_cache(maxsize=65536)
def token_of(label: str, parent: int) -> int:
    return (xxhash.xxh3_64_intdigest(label, parent & 0xFFFF_FFFF) & ~1) - (1 << 63)


@functools.lru_cache(maxsize=65536)
def heads(names: str) -> frozenset[str]:
    """The head word of each name, the last that isn't a suffix; none if a name only tells what the element has."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in NAME_PART.findall(name)]
        if WRAPPERS & set(words):
            return NO_NAMES
        while len(words) > 1 and (words[-1].isdigit() or words[-1] in SUFFIXES):
            words.pop()
        if words and not (words[-1] in EDGES and OWNERS & set(words)):
            found.add(words[-1])
    return frozenset(found)


#: Tags whose presence around and below an element is kept as bits.
BIT = {"article": 1, "main": 2}


class Element:
    """A node of a page. inside and below: bits of the tags of BIT among what is around and what is below it; linked: characters of its own text within links; top: the page."""

    __slots__ = ("below", "chars", "children", "inside", "known", "label", "linked", "names", "other", "parent", "tag", "token", "top")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.parent, self.children, self.known, self.chars, self.below = tag, parent, [], None, None, 0
        self.linked = 0
        self.inside, self.top = (0, self) if parent is None else (parent.inside | BIT.get(parent.tag, 0), parent.top)
        if not attributes:
            self.label, self.names, self.other = tag, NO_NAMES, tag in OTHER_TAGS
            self.token = token_of(tag, parent.token if parent else 0)
            return
        self.label = ".".join([tag, *sorted(attributes.get("class", "").split()), *(["#" + attributes["id"]] if attributes.get("id") else [])])
        self.token = token_of(self.label, parent.token if parent else 0)
        self.names = heads(attributes.get("class", "") + " " + attributes.get("id", ""))
        style = attributes.get("style", "").replace(" ", "").lower()
        self.other = (
            tag in OTHER_TAGS
            or attributes.get("role", "").lower() in OTHER_ROLES
            or "hidden" in attributes
            or attributes.get("aria-hidden", "").lower() == "true"
            or "display:none" in style
            or "visibility:hidden" in style
        )

    def within(self, *tags: str) -> bool:
        return any(self.inside & BIT[t] for t in tags)

    def holds(self, *tags: str) -> bool:
        return any(self.below & BIT[t] for t in tags)

    def add(self, child: Element) -> None:
        """Takes in a child; each element above learns of a tag below it once."""
        self.children.append(child)
        up, bit = self, BIT.get(child.tag, 0)
        while bit and up is not None and not up.below & bit:
            up.below |= bit
            up = up.parent

    def is_other(self) -> bool:
        """Whether the element isn't part of an article; asked once its children are known."""
        if self.known is None:
            self.known = self.judged()
        return self.known

    def judged(self) -> bool:
        """By tag, role and names."""
        if self.other:
            return True
        if self.tag in ("html", "body", "main"):
            return False
        if self.tag == "header":
            return not self.within("article", "main")
        names = self.names & CHROME
        if names & EDGES and self.within("article", "main"):
            names = names - EDGES
        if self.tag == "article":
            names = names & READERS
        if not names or names & READERS and self.holds("main"):
            return False
        if names & COMMENTS or names & READERS and self.within("article", "main"):
            return True
        if names & READERS:
            return not ((names & AUDIENCE or self.tag == "article" or self.holds("article")) and self.is_most())
        return not self.holds("article", "main")

    def is_most(self) -> bool:
        """Whether a block has over half of its page's characters; asked once the page is parsed."""
        if self.tag not in BLOCKS:
            return False
        top = self.top
        if top.chars is None:
            for e in reversed(list(elements(top))):
                e.chars = len(own_text(e)) + sum(c.chars for c in e.children if isinstance(c, Element))
        return 2 * self.chars > top.chars


def attributes_of(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def parse(page: str) -> Element:
    """The tree of a page's block elements and of others that are no part of an article; texts, white space kept, lie between them.

    The time is in proportion to the page, however deep its elements lie: an
    end tag without a start is known by the count of open ones.
    """
    root = at = Element("#page", {}, None)
    place, low, opened, linked = 0, None, Counter(), False

    def left(upto: Element | None) -> Element:
        """Closes elements up to and with one; where the page goes on."""
        e = at
        while e is not upto:
            opened[e.tag] -= 1
            e = e.parent
        opened[e.tag] -= 1
        return e.parent

    for m in iter_tags(page):
        if m.start() > place:
            at.children.append(html.unescape(page[place : m.start()]))
            if linked:
                at.linked += len(at.children[-1].strip())
        place = max(place, m.end())
        if m.start() < place - (m.end() - m.start()):
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag == "a":  # a link in a link ends the first
            linked = not (m[1] or m[4])
        if m[1] or m[4]:
            if opened[tag] > 0:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = left(up)
            elif tag == "p":
                at.add(Element("p", {}, at))
            continue
        if tag in ("br", "hr", "wbr"):
            if tag == "hr":
                at.add(Element("hr", {}, at))
            else:
                at.children.append(" " if tag == "br" else "")
        if tag in VOID:
            continue
        if tag in BLOCKS:
            while at.tag == "p":
                at = left(at)
            if any(opened[t] > 0 for t in CLOSES.get(tag, ())):
                up = at
                while up is not root and up.tag not in CLOSES[tag] and up.tag not in SCOPES:
                    up = up.parent
                if up.tag in CLOSES[tag]:
                    at = left(up)
        more = m[3] or m[6] or ""
        new = Element(tag, attributes_of(more), at) if tag in BLOCKS or tag in OTHER_TAGS or TELLING.search(more) else None
        if new is not None and (tag in BLOCKS or new.judged()):
            at.add(new)
            at = new
            opened[tag] += 1
        if tag in RAW:
            low = low if low is not None else page.lower()
            end = low.find(f"</{tag}", place)
            place = len(page) if end < 0 else end
            if new is not None and at is new:
                at = left(new)
    if place < len(page):
        at.children.append(html.unescape(page[place:]))
    return root


def iter_tags(page: str) -> Iterator[re.Match]:
    """Tags in order; those inside raw content are skipped."""
    at, low = 0, None
    while m := TAG.search(page, at):
        yield m
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if tag in RAW and not (m[1] or m[4]):
            low = low if low is not None else page.lower()
            end = low.find(f"</{tag}", at)
            at = len(page) if end < 0 else end


def blocks(top: Element, static: frozenset[int] = frozenset()) -> Iterator[str]:
    """The texts of the blocks below an element, in page order, without what isn't an article's, nor elements' own texts whose token is static, headings apart."""
    run: list[str] = []

    def flush() -> Iterator[str]:
        if text := " ".join("".join(run).split()):
            yield text
        run.clear()

    kept = lambda e: iter([c for c in e.children if not isinstance(c, str)] if static and e.tag not in HEADINGS and text_token(e) in static else e.children)
    todo: list = [kept(top)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            yield from flush()
        elif isinstance(child, str):
            run.append(child)
        elif child.is_other():
            if child.tag in BLOCKS:
                yield from flush()
        else:
            yield from flush()
            todo.append(kept(child))


def elements(top: Element) -> Iterator[Element]:
    todo = [top]
    while todo:
        at = todo.pop()
        yield at
        todo += [c for c in reversed(at.children) if isinstance(c, Element)]


def own_text(element: Element) -> str:
    return " ".join("".join(c for c in element.children if isinstance(c, str)).split())


def text_token(element: Element, text: str | None = None) -> int | None:
    """The token of an element's own text: an odd number, as those of elements are even; none without text."""
    text = own_text(element) if text is None else text
    return (xxhash.xxh3_64_intdigest(text, element.token & 0xFFFF_FFFF) | 1) - (1 << 63) if text else None


def tokens(root: Element) -> list[int]:
    """The page's tokens in order: each element by its path, and each element's own text with the path."""
    out = []
    for e in elements(root):
        out.append(e.token)
        if text := own_text(e):
            out.append(text_token(e, text))
    return out


def slot_chars(root: Element, static: set[int] | frozenset[int]) -> list[tuple[Element, int, int, int]]:
    """Every element that a reader sees, in page order, with its depth, the characters in and below it that aren't static, and those of them that are links' text."""
    found: list[list] = []
    todo: list[tuple[Element, list | None, int]] = [(root, None, 0)]
    while todo:
        e, up, depth = todo.pop()
        text = own_text(e)
        chars = 0 if not text or text_token(e, text) in static else len(text)
        mine = [e, depth, chars, min(chars, e.linked), up]
        found.append(mine)
        todo += [(c, mine, depth + 1) for c in reversed(e.children) if not isinstance(c, str) and (c.tag not in OTHER_TAGS or c.tag in SEEN)]
    for _, _, chars, links, up in reversed(found):
        if up is not None:
            up[2] += chars
            up[3] += links
    return [(e, depth, chars, links) for e, depth, chars, links, _ in found]
