"""Main-text extraction from HTML by tag-path ratios.

A page is cut into text blocks, each with its root-to-leaf tag path. Per path the text length and the
punctuation of all its blocks are aggregated to ratios, the ratios are smoothed along the page (and
inside a named article down the path, so that its tables and lists follow what is around them) and
fused into a score, and the paths whose score passes a threshold from the page's own scores are
content. Names and elements lower scores. What they call a menu, a list of links or a bar scores half:
ratios tell those, and text there that reads like the article's stays. What they call a place of other
prose (comments, asides, notices, adverts, footers ...), and what lies outside the article, scores a
hundredth, as ratios cannot tell prose from prose. A page all of which lies in a form, or in an element
named after its sidebar, keeps its text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmatch.llm.shared import in_tasks

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "button select option svg canvas object embed iframe audio video map picture output meter progress "
    "math semantics annotation mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mpadded mphantom menclose mstyle".split()
)
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open element of these names, unless one of the second stands between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("tr", "thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("tr", "thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("tr", "thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
#: Elements whose text is no text of the page.
DROPPED = frozenset("head script style noscript template svg canvas object embed iframe button select option input textarea label legend audio video title annotation".split())
#: Elements that are other parts of a page; what they hold scores lower.
PARTS = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: Words of class and id values that name other parts of a page.
NAMED = frozenset(
    "nav navbar navigation menu menus submenu topbar breadcrumb breadcrumbs pagination pager header masthead footer colophon sidebar sidebars aside rail widget widgets "
    "ad ads advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "notice notices alert alerts cookie cookies consent gdpr privacy popup modal overlay newsletter subscribe subscription signup login signin paywall "
    "comment comments commentlist respond replies reply disqus discussion feedback share sharing social related recommended recommendations outbrain taboola toolbar search hidden".split()
)
#: Of these, elements, roles and names of link lists and bars.
LINKS = frozenset(
    "nav menu navigation menubar toolbar navbar menus submenu topbar breadcrumb breadcrumbs pagination pager share sharing social search".split()
)
COMMENTS = frozenset("comment comments commentlist respond replies reply disqus discussion feedback".split())
#: Words that name the article itself; where one stands on an element in a name of its own, the list above does not count there.
MAIN = frozenset("article articlebody articletext content maincontent main post postbody story storybody entry entrycontent body bodytext text".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.S)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
NAME_WORDS = re.compile(r"[A-Za-z]+?(?=[A-Z][a-z]|[^A-Za-z]|$)|[A-Za-z]+")
#: Names that say what a page has, how it is filed or whether comments are open, not what the element is.
ABOUT = re.compile(
    r"(?:has|no|with|without)(?:[-_]|(?=[A-Z]))|(?:category|cat|tag|topic|type|format|status|author|lang)[-_]"
    r"|(?:comments?|replies|discussion|feedback|sharing|pings?)[-_](?:open|closed|enabled|disabled|allowed|on|off)$"
)


OTHER = 0.01  #: Factor on the score for each element around a block that is a place of other prose, and for a block outside the article.
BAR = 0.5  #: Factor for a block in a menu, list of links or bar, wherever that is.
NAMED_SHARE, PLAIN_SHARE = 0.1, 0.3  #: Thresholds as shares of the page's score: where the article is named, and elsewhere.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


@dataclass
class Open:
    name: str
    block: bool
    out: bool  #: Text here is none of the page's.
    other: int  #: Elements around, this one included, that are places of other prose.
    bar: bool  #: In a menu, list of links or bar.
    main: int  #: 0: outside; else how strongly the markup names this as the article.
    linked: bool  #: Inside a link.
    path: int = 0
    node: int = 0
    top: int = 0  #: Path of the element that is named as the article.


@dataclass
class Block:
    name: str
    path: int
    node: int
    main: int
    other: int
    bar: bool
    top: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Page:
    """The blocks of a page in order, and the parents of their paths and elements (of which the first is the page itself)."""

    blocks: list[Block] = field(default_factory=list)
    path_parent: list[int] = field(default_factory=lambda: [0])
    node_parent: list[int] = field(default_factory=lambda: [0])
    node_path: list[int] = field(default_factory=lambda: [0])


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw)} if raw.strip(" /") else {}


def _opened(name: str, raw: str, parent: Open | None) -> tuple[Open, str]:
    """The element, and its step of a tag path."""
    attrs = _attributes(raw)
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    names = [{w.lower() for w in NAME_WORDS.findall(n)} | {n.lower()} for n in named.split() if not ABOUT.match(n)]
    words = set().union(*names)
    role = attrs.get("role", "").lower()
    main = parent.main if parent else 0
    # An element that names the article is one, unless it names comments or another part as well.
    article = name == "article" or attrs.get("itemprop", "").lower() == "articlebody"
    kept = article or name in ("div", "section", "td") and any(n & MAIN - {"body", "text"} and not n & NAMED for n in names)
    not_it = COMMENTS | {"hidden"} if kept else NAMED - ({"header", "banner"} if main else set())
    other = name in PARTS or role in ROLES or name == "header" and not main or bool(words & not_it) and name not in ("html", "body", "main")
    out = bool(parent and parent.out) or name in DROPPED or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
    out = out or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))
    if not other:
        if article:
            main = 3
        elif (name == "main" or role == "main") and main < 2:
            main = 2
        elif words & MAIN and not main and name in ("div", "section", "td"):
            main = 1
    around = parent.other if parent else 0
    bar = other and not (({name} & PARTS) | ({role} & ROLES) | ({"header"} if name == "header" and not main else set()) | words & not_it) - LINKS
    return Open(name, name not in INLINE, out, around + (other and not bar), bar or bool(parent and parent.bar), main, name == "a" or bool(parent and parent.linked)), ".".join([name, *sorted(named.split())])


def read(page: str) -> Page:
    """The text blocks of a page with their paths."""
    stack: list[Open] = []
    found = Page()
    paths: dict[tuple[int, str], int] = {}
    names: Counter = Counter()  # of the open elements
    now: Block | None = None
    at = 0

    def text(raw: str) -> None:
        nonlocal now
        if not raw or (stack and stack[-1].out):
            return
        if now is None:
            if raw.isspace():
                return
            around = stack[-1] if stack else Open("", True, False, 0, False, 0, False)
            near = next((o.name for o in reversed(stack) if o.block), "")
            now = Block(near, around.path, around.node, around.main, around.other, around.bar, around.top)
        value = html.unescape(raw)
        now.parts.append(value)
        if stack and stack[-1].linked:
            now.linked += len("".join(value.split()))

    def cut() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                found.blocks.append(now)
            now = None

    def pop_to(index: int) -> None:
        if any(o.block for o in stack[index:]):
            cut()
        names.subtract(o.name for o in stack[index:])
        del stack[index:]

    def close(wanted: tuple[str, ...], stop: tuple[str, ...]) -> None:
        if not any(names[w] for w in wanted):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in wanted:
                pop_to(i)
                return
            if stack[i].name in stop:
                return

    while at < len(page):
        next_tag = page.find("<", at)
        if next_tag < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, next_tag)
        if m is None:  # a bare "<" is text
            text(page[at : next_tag + 1])
            at = next_tag + 1
            continue
        text(page[at:next_tag])
        at = m.end()
        if m["name"]:
            name, raw = m["name"].lower(), m["attrs"] or ""
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in VOID:
                if name == "br":
                    text(" ")
                elif name == "hr":
                    close(("p",), ("article", "body", "div", "section", "td"))
                    cut()
                continue
            if name in ("html", "body") and names[name]:
                continue
            if name in CLOSES_P and names["p"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == "p":
                        pop_to(i)
                        break
                    if stack[i].block:
                        break
            if name in ENDS:
                close(*ENDS[name])
            if name == "body":
                close(("head",), ("html",))
            parent = stack[-1] if stack else None
            opened, step = _opened(name, raw, parent)
            opened.path, opened.node = (parent.path, parent.node) if parent else (0, 0)
            if opened.block:
                cut()
                key = (opened.path, step)
                if key not in paths:
                    paths[key] = len(found.path_parent)
                    found.path_parent.append(opened.path)
                found.node_parent.append(opened.node)
                found.node_path.append(paths[key])
                opened.path, opened.node = paths[key], len(found.node_parent) - 1
            opened.top = opened.path if opened.main > (parent.main if parent else 0) else parent.top if parent else 0
            stack.append(opened)
            names[name] += 1
        elif m["end"]:
            name = m["end"].lower()
            if names[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        pop_to(i)
                        break
                    if name in INLINE and stack[i].block:
                        break
            elif name == "p":
                cut()
        elif m["cdata"] is not None:
            text(m["cdata"])
    cut()
    return found


def sums(parent: list[int], at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one row a block) over each path or element ``at`` which a block stands, with all below it."""
    out = np.zeros((len(parent), values.shape[1]))
    np.add.at(out, at, values)
    for k in range(len(parent) - 1, 0, -1):  # a parent comes before what is in it
        out[parent[k]] += out[k]
    return out


def smoothed(x: np.ndarray) -> np.ndarray:
    """Along the page, by a Gaussian over five blocks."""
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    if len(x) < 5:
        return x
    return np.convolve(x, kernel, "same") / np.convolve(np.ones(len(x)), kernel, "same")


def path_ratios(page: Page, top: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each path: characters and punctuation marks a block, and the share of its text that is no link.

    Below the path ``top`` a path's first two ratios are halfway between its own and those of the path around it,
    which at ``top`` itself are those of all it holds.
    """
    at = np.array([b.path for b in page.blocks])
    facts = np.array([[len(b.text), len(PUNCTUATION.findall(b.text)), 1, b.linked] for b in page.blocks], float)
    own = np.zeros((len(page.path_parent), 4))
    np.add.at(own, at, facts)
    free = 1 - own[:, 3] / np.maximum(own[:, 0], 1)
    whole = sums(page.path_parent, at, facts)
    own = np.where(own[:, 2:3] > 0, own, whole)
    ratio = own[:, :2] / np.maximum(own[:, 2:3], 1)
    if top is not None:
        below = np.zeros(len(ratio), bool)
        below[top] = True
        ratio[top] = whole[top, :2] / max(whole[top, 2], 1)
        for k in range(top + 1, len(ratio)):
            if below[page.path_parent[k]]:
                below[k] = True
                ratio[k] = 0.5 * ratio[k] + 0.5 * ratio[page.path_parent[k]]
    return ratio[:, 0], ratio[:, 1], free


def priors(page: Page, inside: np.ndarray | None = None) -> np.ndarray:
    """What names leave of each block's score; a bar pays once, wherever it lies, of the best that other text keeps."""
    bar = np.array([b.bar for b in page.blocks])
    prior = OTHER ** np.array([b.other for b in page.blocks], float)
    if inside is not None:
        prior = prior * np.where(inside | bar, 1.0, OTHER)
    return np.where(bar, BAR * prior * prior.max(where=~bar, initial=0 if not bar.all() else 1), prior)


def scores(page: Page, inside: np.ndarray | None = None, top: int | None = None) -> np.ndarray:
    """A score for each path: its smoothed ratios fused, less for other parts and what is not ``inside``."""
    at = np.array([b.path for b in page.blocks])
    text, marks, free = (r[at] for r in path_ratios(page, top))
    fused = np.sqrt(smoothed(text) * (1 + smoothed(marks))) * np.maximum(0.15, free) ** 2 * priors(page, inside)
    total = np.zeros((len(page.path_parent), 2))
    np.add.at(total, at, np.stack([fused, np.ones(len(at))], axis=1))
    return total[:, 0] / np.maximum(total[:, 1], 1)


def region(page: Page, share: float = 0.7) -> tuple[np.ndarray, int | None]:
    """Which blocks lie in the article, and its path if the markup names it.

    A name counts where at least half of the text that is no link lies there (in another part of the
    page text counts a hundredth); a first heading beside the article in its main part belongs to it.
    Elsewhere the article is the innermost element that holds ``share`` of the scored text.
    """
    blocks = page.blocks
    plain = np.array([max(0, len(b.text) - b.linked) for b in blocks]) * OTHER ** np.array([b.other + b.bar for b in blocks], float)
    main = np.array([b.main for b in blocks])
    for level in (3, 2, 1):
        inside = main >= level
        if inside.any() and 2 * plain[inside].sum() >= plain.sum():
            top = min(b.top for b, own in zip(blocks, inside) if own)  # a path comes before what is in it
            beside = np.array([bool(b.main) and not b.linked and b.name == "h1" for b in blocks])
            return inside | beside, top
    at = np.array([b.node for b in blocks])
    weight = scores(page)[[b.path for b in blocks]] * [len(b.text) for b in blocks]
    held = sums(page.node_parent, at, np.stack([weight, np.ones(len(blocks))], axis=1))
    inner = [k for k in range(len(held)) if held[k, 0] >= share * weight.sum() and held[k, 1] > 1]
    best = max(inner, default=0)  # of elements that hold so much each is in the one before
    around = np.zeros(len(page.node_parent), bool)
    around[best] = True
    for k in range(best + 1, len(around)):
        around[k] = around[page.node_parent[k]]
    return around[at], None


def chosen(page: Page) -> np.ndarray:
    """Which blocks are content: those on a path whose score passes the threshold, and the headings of such."""
    blocks = page.blocks
    inside, named = region(page)
    score = scores(page, inside, named)[[b.path for b in blocks]]
    weight = score * [len(b.text) for b in blocks]
    level = (score * weight).sum() / max(weight.sum(), 1e-300)
    stays = score >= (PLAIN_SHARE if named is None else NAMED_SHARE) * level
    for i in range(len(blocks) - 2, -1, -1):  # a heading has few characters and no punctuation: it goes with what it heads
        if blocks[i].name in HEADINGS and not blocks[i].linked and inside[i] == inside[i + 1] and (blocks[i].other, blocks[i].bar) == (blocks[i + 1].other, blocks[i + 1].bar):
            stays[i] |= stays[i + 1]
    return stays


def extract(page: str | None) -> str:
    """The main text of one page: content blocks in page order, joined by line feeds; '' if there are none."""
    found = read(page) if page else Page()
    if not found.blocks:
        return ""
    return "\n".join(b.text for b, ok in zip(found.blocks, chosen(found)) if ok)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: ``page_id, url, text, n_chars``.

    Null and empty pages, and pages without content, give '' and 0; every row stands for itself, so
    nulls elsewhere and repeated rows pass through; further columns are ignored; an empty table gives
    an empty result. Whole pages are read, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return in_tasks(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint", text=2)
