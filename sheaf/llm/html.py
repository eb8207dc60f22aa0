"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with the path of block-level tags from the root to it. Per path, text
length and punctuation are summed and divided by the number of its blocks. The two ratios are fused, smoothed
over neighbouring blocks in page order, and paths whose mean value reaches a threshold (a share of the standard
deviation) are content paths. The innermost element that holds nearly all text of content paths is the article;
what is no content of its own (menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader
comments, by element, role or class name; lists of links) is left out of it. Everything else in it stays.

A class or id says so if all its words do ("cookie-notice", "sidebar-box"). If only some do ("social-security",
"has-sidebar"), the element goes only if no tag path below it is a content path.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Threshold in standard deviations of the smoothed values; weights of the neighbours in smoothing; share of the
#: content that an element must hold to be entered; share of link text that makes a block a menu entry.
THRESHOLD, SMOOTH, DOMINANT, LINKED = 0.4, (0.25, 0.5, 0.25), 0.8, 0.7

# Element, role and class names of HTML pages.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is no markup.
RAW = frozenset("script style title textarea noembed noframes xmp iframe".split())
OUT = frozenset("aside audio button canvas datalist dialog footer form head iframe math menu nav noembed noframes noscript object script search select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tooltip".split())
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies"
    " disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup"
    " promo promoted promotion recommended related replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription"
    " tags teaser toolbar topbar tracking widget widgets".split()
)
#: Words that say nothing more beside one of ``NAMES``.
PLAIN = frozenset("area bar block body bottom box button buttons container content icon icons inner item items left link links list main outer page panel right row section site text top wrap wrapper".split())
#: Those that make an article element none of its own.
ASIDES = frozenset("ad ads advert advertisement comment comments promo promoted recommended related replies reply response sponsored teaser widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl menu table pre blockquote".split())
#: An opening tag of the first kind ends an open one of the second, up to the nearest of the third.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

#: A tag's attributes, in which a few quoted values may hold "<"; a tag that does not close so ends at the next "<". Nothing is
#: read again for more than some dozens of starts, so the work is linear in the page.
_PLAIN = r"""(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+"""
_WITH_ANGLES = r"""(?:"[^"<]*+(?:<[^"<]*+){1,8}"|'[^'<]*+(?:<[^'<]*+){1,8}')"""
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<shut>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<rest>{_PLAIN}(?:{_WITH_ANGLES}{_PLAIN}){{0,4}})>"
    r"|<(?P<shut2>/?)(?P<tag2>[a-zA-Z][^\s/<>]*+)(?P<rest2>[^<>]*+)(?:>|(?=<)|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？،؟।]")


#: For each kind of tag that ends another: the tags at which the look for an open one stops.
_STOPS = {tag: frozenset(closes.split()) | frozenset(within.split()) for tag, (closes, within) in ENDS.items()}
MENUS = frozenset(("ul", "ol", "menu"))


class Node:
    """An element, with what its ancestors say of it; what lies below it is summed up later, children first."""

    __slots__ = ("tag", "parent", "soft", "weak", "depth", "path", "size", "holds", "near", "hard", "hard_but_form", "inside", "some_weak", "list_depth", "menu_depth", "own", "flag")

    def __init__(self, tag: str, parent: Node | None, hard: bool, soft: bool, weak: bool, paths: dict):
        up = parent
        self.tag, self.parent, self.soft, self.weak = tag, parent, soft, weak
        self.depth = up.depth + 1 if up else 0
        self.path = paths.setdefault((up.path if up else -1, tag), len(paths))  # a number for each path
        self.size, self.holds, self.own, self.flag = 0, False, 0, False
        # itself or an ancestor: no content, no content but a form, main part, weakly named; the depth of the nearest list and menu
        self.hard = hard or bool(up and up.hard)
        self.hard_but_form = hard and tag != "form" or bool(up and up.hard_but_form)
        self.inside = tag in ("article", "main") or bool(up and up.inside)
        self.some_weak = weak or bool(up and up.some_weak)
        self.list_depth = self.depth if tag in LISTS else up.list_depth if up else -1
        self.menu_depth = self.depth if tag in MENUS else up.menu_depth if up else -1
        # the nearest element at which the look for an open one of each kind stops
        self.near = up.near if up else {}
        here = [kind for kind, stops in _STOPS.items() if tag in stops]
        if here:
            self.near = {**self.near, **dict.fromkeys(here, self)}


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is no content by what it is, by how it is called, and by a part of how it is called."""
    hard, soft, weak = tag in OUT, tag == "header", False
    if attributes.strip():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                if tag in ("html", "body", "main") or name == "id" and tag in HEADINGS:  # a heading's id is a link target
                    continue
                telling = ASIDES if tag == "article" else NAMES
                for called in value.split():
                    names = {p.lower() for p in _NAME_PART.findall(called)}
                    if names & telling:
                        whole = names <= telling | PLAIN and not ("header" in names and len(names) > 1)
                        soft, weak = soft or whole, weak or not whole
            elif name == "role":
                hard |= value.lower() in ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hard = True
    return hard, soft, weak


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements in page order, and (element, text, characters inside links) of every block, character references decoded."""
    paths: dict = {}
    top = Node("", None, False, False, False, paths)
    nodes, node, out, parts, linked, link = [top], top, [], [], [], 0
    open_, endless = defaultdict(int), set()  # how many of a tag are open here; inline tags that end nowhere below

    def close() -> None:
        text = " ".join(markup.unescape("".join(parts)).split())
        if text:
            out.append((node, text, len("".join(linked))))
        parts.clear()
        linked.clear()

    def leave(last: Node) -> Node:
        """Close all open elements up to ``last``; the element that holds it."""
        x = node
        while True:
            open_[x.tag] -= 1
            if x is last:
                return x.parent
            x = x.parent

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            parts.append(page[at:stop])
            if link:
                linked.append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, shut, rest = tag.lower(), m["shut"] or m["shut2"], m["rest"] or m["rest2"] or ""
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = 0 if shut else 1
        elif tag in BLOCKS or tag in OUT:
            close()
            if shut:
                if open_[tag]:
                    up = node
                    while up.tag != tag:
                        up = up.parent
                    node, link = leave(up), 0
            elif tag not in VOID:
                if tag in ENDS:
                    up = node.near.get(tag)
                    if up is not None and up.tag in ENDS[tag][0].split():
                        node = leave(up)
                elif tag in BLOCKS and node.tag == "p":
                    node = leave(node)
                node = Node(tag, node, *_marks(tag, rest), paths)
                nodes.append(node)
                open_[tag] += 1
                if tag in RAW:
                    end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                    at = end.end() if end else len(page)
                    node = leave(node)
        elif rest and not shut and tag not in VOID and tag not in endless and _marks(tag, rest)[0]:
            # an inline element that is no content, as far as its end tag
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(tag)
    close()
    return nodes, out


def blocks(page: str) -> list[tuple[Node, str, int]]:
    return parse(page)[1]


def _up(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def _below(nodes: list[Node], start: dict[Node, int]) -> dict[Node, int]:
    """Sums of ``start`` over each element and all below it, for elements that have some below."""
    total: dict[Node, int] = dict(start)
    for x in reversed(nodes):  # an element comes after the one that holds it
        if x in total and x.parent:
            total[x.parent] = total.get(x.parent, 0) + total[x]
    return total


def _from_above(nodes: list[Node], own) -> None:
    """Set ``flag`` of every element: whether ``own`` holds for it or an ancestor."""
    for x in nodes:
        x.flag = bool(x.parent and x.parent.flag) or own(x)


def _content_paths(kept: list[tuple[Node, str, int]]) -> set[int]:
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text, links in kept:
        length[node.path] += max(0, len(text) - links)
        marks[node.path] += len(_PUNCTUATION.findall(text))
        count[node.path] += 1
    fused = [math.log1p(length[p] / count[p]) * math.log1p(marks[p] / count[p]) for p in (n.path for n, *_ in kept)]
    before, here, after = SMOOTH
    smooth = [before * fused[max(i - 1, 0)] + here * x + after * fused[min(i + 1, len(fused) - 1)] for i, x in enumerate(fused)]
    mean = sum(smooth) / len(smooth)
    limit = THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    value = defaultdict(float)
    for (node, *_), x in zip(kept, smooth):
        value[node.path] += x / count[node.path]
    return {p for p, v in value.items() if v >= limit and length[p]}


def main_text(page: str) -> str:
    """The main text of one page, blocks joined by two line feeds; '' for a page without content, however broken its markup.

    Time and memory grow in proportion to the page, also with unclosed tags and deep nesting.
    """
    nodes, found = parse(page)
    total = sum(len(t) for _, t, _ in found)
    sizes: dict[Node, int] = defaultdict(int)
    for node, text, _ in found:
        sizes[node] += len(text)
    for x, size in _below(nodes, sizes).items():
        x.size = size
    for x in reversed(nodes):  # whether a main element with text is the element itself or below it
        x.holds |= x.size > 0 and x.tag in ("article", "main", "h1") and not (x.soft or x.weak and x.tag == "article")
        if x.holds and x.parent:
            x.parent.holds = True

    _from_above(nodes, lambda x: x.soft and x.tag != "header" and not (x.holds and x.size > total / 2))
    named = {x for x in nodes if x.flag}
    _from_above(nodes, lambda x: x.soft and x.tag == "header")
    # if nothing is left, names do not count; then neither does a form around everything
    kept = [b for b in found if not (b[0].hard or b[0] in named or b[0].flag and not (b[0].inside and b[0].tag in HEADINGS))]
    kept = kept or [b for b in found if not b[0].hard]
    kept = kept or [b for b in found if not b[0].hard_but_form]
    if not kept:
        return ""
    content = _content_paths(kept)
    if any(b[0].some_weak for b in kept):
        good = _below(nodes, {node: 1 for node, text, links in kept if node.path in content and links < LINKED * len(text)})
        _from_above(nodes, lambda x: x.weak and not x.holds and x not in good)
        left = [b for b in kept if not b[0].flag]
        if left and len(left) < len(kept):
            kept, content = left, _content_paths(left)
    own: dict[Node, int] = defaultdict(int)
    for node, text, links in kept:
        if node.path in content:
            own[node] += max(0, len(text) - links)
    weight, below = _below(nodes, own), defaultdict(list)
    for x in nodes:
        if x in weight and x.parent:
            below[x.parent].append(x)
    article = nodes[0]
    while article.tag not in ("article", "main") or any(x.tag == "article" for x in below[article]):
        inner = max(below[article], key=weight.__getitem__, default=None)
        if inner is None or inner.tag in HEADINGS or inner.tag in ("p", "li", "td", "blockquote", "pre") or weight[inner] < DOMINANT * weight[article]:
            break
        article = inner
    _from_above(nodes, lambda x: x is article)
    chosen = [(b, b[0].path in content) for b in kept if b[0].flag]
    sure = [k for k, (_, c) in enumerate(chosen) if c]
    whole = article.tag in ("article", "main")
    listed = [b[0].list_depth > article.depth for b, _ in chosen]
    last = max((k for k, x in enumerate(listed) if x), default=-1)
    text = []
    for k, ((node, words, links), c) in enumerate(chosen):
        menu = links >= LINKED * len(words) and node.menu_depth >= article.depth
        lead = node.tag in HEADINGS and sure and k < sure[0]
        closing = sure and k > sure[-1] and (listed[k] or node.tag in HEADINGS and k < last)
        if not menu and (whole or c or lead or closing or sure and sure[0] <= k <= sure[-1]):
            text.append(words)
    return "\n\n".join(text)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in batches:
        texts = [main_text(h) if h else "" for h in batch.column("_html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``page_id``, ``url``, ``text``, ``n_chars``), one row per row of ``pages``.

    ``text`` is the main text: blocks joined by two line feeds, white space in a block as one space, character
    references decoded. A null or empty page, or one without content, has an empty text. Cut off markup ends at the
    end of the page. Repeated rows, null ids and an empty table are nothing special; other columns are not
    looked at.
    """
    d = pages.select(pages[id_col].cast("long").alias("_id"), pages[url_col].alias("_url"), pages[html_col].alias("_html"))
    return d.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
