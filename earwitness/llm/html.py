"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to the elements above them,
half as much for each step, less the share of their text that is link text. The
element with most points is the main container. It is kept with those siblings
that score well too, without the parts that are not article text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import partial

from pyspark.sql import DataFrame

from earwitness.llm.common import extend

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript template xmp svg object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements that end an open one of these kinds, looked for up to the boundary elements.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "option": ("option",)}
BOUNDARY = frozenset("ul ol dl table article section div body html main".split())
#: Elements that are never article text.
DROPPED = frozenset("head nav header footer aside button input dialog menu search audio video canvas annotation annotation-xml".split()) | RAW
#: Elements that are not article text unless they hold the page's article.
FORMS = frozenset("form fieldset".split())
#: Words of class, id or role that mark such parts unless they hold the page's article, and the elements that such a word can't drop.
NOISE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary banner contentinfo ad ads advert adverts advertisement "
    "advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup comment comments "
    "commentlist disqus reply replies respond share sharing social related recommended pagination pager widget toolbar search login".split())
NEVER_NOISE = frozenset("html body main article".split())
#: Of these, words of reader comments: such a part goes wherever there is other text, however long it is.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that make a name say how a part looks or works, and not what it is.
STATES = frozenset("has no not with without is open closed enabled disabled hide show".split())

_TAG = re.compile(r"""(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "items", "noise", "named", "comments", "own", "link", "score", "has_block")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, named: bool = False, comments: bool = False) -> None:
        self.tag, self.parent, self.noise, self.named, self.comments = tag, parent, noise, named, comments
        self.items: list[Node | str] = []
        self.own = self.link = 0
        self.score = 0.0
        self.has_block = False


def _noise(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is never text, whether its name says that it isn't article text, and that it holds comments."""
    if tag in DROPPED:
        return True, False, False
    named, comments = tag in FORMS, False
    if tag in NEVER_NOISE or not attributes:
        return False, named, False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            for one in value.split():
                words = {w.lower() for w in _WORDS.findall(one)}
                if words & NOISE and not words & STATES:
                    named = True
                    comments = comments or bool(words & COMMENTS)
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True, False, False
    return False, named, comments


def parse(page: str) -> Node:
    """The element tree of a page; whatever is not well formed ends where browsers would end it, about."""
    root = here = Node("#root", None)
    at, n, open_tags = 0, len(page), Counter()

    def up_to(node: Node) -> Node:
        """Closes all elements from the innermost to ``node``."""
        inner = here
        while inner is not node.parent:
            open_tags[inner.tag] -= 1
            inner = inner.parent
        return inner

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            here.items.append(html.unescape(page[at:]))
            break
        if lt > at:
            here.items.append(html.unescape(page[at:lt]))
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt + 1)
        if not m:
            here.items.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if open_tags[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = up_to(node)
            elif tag in ("p", "br"):
                here.items.append(" ")
            continue
        ends = ("p",) if tag in CLOSES_P else ENDS.get(tag, ())
        if any(open_tags[x] for x in ends):
            node, found = here, None
            while node is not root and node.tag not in BOUNDARY - set(ends):
                if node.tag in ends:
                    found = node
                    if tag in CLOSES_P:
                        break
                node = node.parent
            if found is not None:
                here = up_to(found)
        new = Node(tag, here, *_noise(tag, m[3]))
        here.items.append(new)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
        elif tag not in VOID and not (m[3].endswith("/") and tag not in INLINE and tag not in CLOSES_P):
            here = new
            open_tags[tag] += 1
    return root


def _measure(root: Node) -> list[Node]:
    """All kept nodes in order; own inline text and link text of each block are counted."""
    order, stack = [], [(root, root, False)]
    while stack:
        node, block, linked = stack.pop()
        order.append(node)
        later = []
        for x in node.items:
            if isinstance(x, str):
                size = len(x.split()) and len(" ".join(x.split()))
                block.own += size
                block.score += x.count(",") + x.count("、") + x.count("，")
                if linked:
                    block.link += size
            elif not x.noise:
                inline = x.tag in INLINE or x.tag == "br"
                if not inline:
                    block.has_block = True
                later.append((x, block if inline else x, linked or x.tag == "a"))
        stack.extend(reversed(later))
    return order


def _totals(root: Node) -> dict[int, tuple[int, int, int]]:
    """Text, link text and links of each node's whole subtree, without its noise."""
    out: dict[int, tuple[int, int, int]] = {}
    for x in reversed(_kept(root)):
        text, link, links = x.own, x.link, int(x.tag == "a")
        for y in x.items:
            if not isinstance(y, str) and not y.noise:
                more = out[id(y)]
                text, link, links = text + more[0], link + more[1], links + more[2]
        out[id(x)] = text, link, links
    return out


def _kept(root: Node) -> list[Node]:
    """All nodes but noise, parents first."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [y for y in reversed(x.items) if not isinstance(y, str) and not y.noise]
    return order


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 title".split())
#: Elements whose own text makes them a paragraph of the element above.
_PARAGRAPH = frozenset("p pre li td th dd dt blockquote figcaption".split())
#: Share of its points that an element with a name of NOISE keeps and passes on, where it is not dropped.
DISCOUNT = 0.1
#: Sibling of the best container: least share of its points.
SIBLING = 0.3
#: Link share from which a list of links is a menu.
MENU_SHARE, MENU_LINKS = 0.8, 3


def _value(node: Node) -> float:
    """Points of a paragraph or of a block's own text."""
    if node.tag in INLINE or not node.own or node.tag in _HEADINGS:
        return 0.0
    return (1 + node.score + node.own / 100) * (1 - node.link / node.own)


def _drop_named(root: Node) -> None:
    """What is not article text by its name or its place becomes noise.

    An element with a name of NOISE stays where it holds a main, the article with most
    points, or most points of the page. Comments stay only where they are all there
    is. An article within an article is a comment on it, by the HTML standard, where
    the outer one has text of its own.
    """
    order = _measure(root)
    points = {id(x): _value(x) for x in order}
    in_comments, around = {id(root): root.comments}, {id(root): None}
    own = dict(points)  # without articles within
    for x in order[1:]:
        in_comments[id(x)] = x.comments or in_comments[id(x.parent)]
        around[id(x)] = x.parent if x.parent.tag == "article" else around[id(x.parent)]
    for x in reversed(order):
        if x.parent is not None:
            points[id(x.parent)] += points[id(x)]
            if x.tag != "article":
                own[id(x.parent)] += own[id(x)]
    whole = points[id(root)]
    articles = [x for x in order if x.tag == "article" and points[id(x)] > 0]
    articles = [x for x in articles if not in_comments[id(x)]] or articles
    held = {id(x): x for x in [*(x for x in order if x.tag == "main"), *([max(articles, key=lambda x: points[id(x)])] if articles else [])]}
    for x in reversed(order):
        if id(x) in held and x.parent is not None:
            held[id(x.parent)] = x.parent
    for x in order:
        outer = around[id(x)]
        nested = x.tag == "article" and outer is not None and own[id(outer)] > 0
        most = whole - points[id(x)] <= 0 if x.comments else 2 * points[id(x)] > whole
        x.noise = x is not root and (nested or (x.named and id(x) not in held and not most))
        x.own, x.link, x.score, x.has_block = 0, 0, 0.0, False


def best_container(root: Node) -> list[Node]:
    """The container with most points and its good siblings, in page order."""
    _drop_named(root)
    order = _measure(root)
    arriving: dict[int, float] = {}
    points: dict[int, float] = {}
    for node in reversed(order):
        if node.tag not in INLINE and node.own and node.tag not in _HEADINGS:
            up = node.parent if node.tag in _PARAGRAPH else node
            share = DISCOUNT if node.named and up is not node else 1.0
            if up is not None:
                arriving[id(up)] = arriving.get(id(up), 0.0) + _value(node) * share
        if id(node) in arriving:
            passed = arriving[id(node)] * (DISCOUNT if node.named else 1.0)
            if node.tag not in INLINE:
                points[id(node)] = passed
                passed /= 2
            if node.parent is not None:
                arriving[id(node.parent)] = arriving.get(id(node.parent), 0.0) + passed
    if not points:
        return [root]
    totals = _totals(root)
    scored = [x for x in order if id(x) in points]
    best = max(scored, key=lambda x: points[id(x)])
    up = best
    while up is not None:  # a container that says what it is
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    least = SIBLING * points.get(id(best), 0.0)
    out = []
    for x in best.parent.items:
        if isinstance(x, str) or x.noise:
            continue
        text, link, _ = totals[id(x)] if x is not best else (1, 0, 0)
        own = (1 + text / 100) * (1 - link / text) if text else 0.0
        if x is best or (x.tag in _HEADINGS and best.tag != "article") or (max(points.get(id(x), 0.0), own if x.tag in _PARAGRAPH else 0.0) >= least and best.tag not in ("article", "main")) or (x.tag == "article" and best.tag == "article"):
            out.append(x)
    return out


def _is_menu(x: Node, total: tuple[int, int, int], article: bool) -> bool:
    """A list of links, unless it belongs to the article: text of the article comes before it, beside it."""
    text, link, links = total
    if links < MENU_LINKS or link < MENU_SHARE * text:
        return False
    return not article


def _text(roots: list[Node]) -> str:
    parts: list[str] = []
    stack: list[Node | str] = list(reversed(roots))
    totals: dict[int, tuple[int, int, int]] = {}
    for r in roots:
        totals |= _totals(r)
    chosen = {id(r) for r in roots}
    told: set[int] = set()  # elements within which a paragraph has been read
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x.noise and id(x) not in chosen:
            continue
        if x.tag in ("ul", "ol", "dl", "table") and _is_menu(x, totals[id(x)], x.parent is not None and id(x.parent) in told):
            continue
        if x.tag == "p" and x.parent is not None and totals[id(x)][1] < MENU_SHARE * totals[id(x)][0]:
            told.add(id(x.parent))
        if x.tag in INLINE:
            stack.extend(reversed(x.items))
        else:
            parts.append(" ")
            stack.append(" ")
            stack.extend(reversed(x.items))
    return " ".join("".join(parts).split())


def main_text(page: str | None) -> str:
    """Article text: character references decoded, white space one space, blocks joined by one space."""
    return _text(best_container(parse(page))) if page else ""


def _extractor(column: str):
    return lambda batch: {"text": [main_text(t) for t in batch.column(column).to_pylist()]}


def extracted(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """Columns ``keep`` of ``pages`` and ``__out.text``, the main text of every whole page.

    A null or empty page, or one without text outside noise, gives the empty
    string. Rows stay rows, whatever their ids.
    """
    return extend(pages, partial(_extractor, html_col), "text string", keep)
