"""Main text of HTML pages by tree scoring.

The page becomes a tree of elements. Every paragraph-like block earns points
for its length and its commas, less what its links make up, and passes them to
its ancestors: all to its parent, half to its grandparent, and a third, a
quarter and so on further up. A container's points are discounted by its own
link density, and names that announce content or furniture shift them. The best
container is kept with those siblings that score near it or read like prose;
inside, whatever is navigation, notice, advert, form or comment goes.

A declared <article> weighs more than another container, but is not taken
whatever its score. Lists of links go if they read like menus; references stay.

A name alone seldom decides. Names that articles carry as well ("search-results",
"header") take a second sign: mostly links, controls for little text, or a place
beside the best container without half its score. A block named as furniture that
holds most of the page's prose and its head or article is a wrapper, and stays.

Each page is handled on its own, so nothing is shuffled, in time and memory that
grow with the page alone. A null or empty page gives the empty text. Repeated
rows each give their own, an empty table none; null ids and addresses are passed
on. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._shared import arrow_schema

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag. Possessive, so that it is read once whether it ends or not.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"\b(id|class|role|itemprop|hidden|aria-hidden|style|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"[\s​﻿]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul menu".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCORED = frozenset("p pre blockquote li td dd div section article h2 h3 h4".split())
#: A new element of the key closes open ones of the value, up to a scope.
_CLOSES = {t: frozenset(["p"]) for t in _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "figcaption"}} | {
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]), "tfoot": frozenset(["tr", "td", "th", "tbody", "thead"]),
}
_SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "tbody": frozenset(["table"]), "tfoot": frozenset(["table"])}
#: Inline elements never hold a paragraph back from closing.
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_FURNITURE = frozenset("nav footer aside form button dialog menu fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|newsletter|subscri\w*|signup|sign-up|login|modal|popup|overlay|paywall"
    r"|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side-bar|aside|widget\w*|footer\w*|foot|header|masthead|topbar|toolbar|skip\w*|pager|pagination|tagcloud"
    r"|social\w*|shar(?:e|ing)\w*|follow|related\w*|recommend\w*|more-stories|comment\w*|replies|respond|disqus\w*|search\w*|copyright|disclaimer|alert|toast)(?=$|[\s_-])",
    re.I,
)
#: Names that articles carry as well: such a block goes only if it is mostly links.
_DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:tags?|trending|popular|discussion|form|legal)(?=$|[\s_-])", re.I)
#: Names of furniture that name a text's subject too, if a noun follows that is not one of a box.
_SUBJECT = re.compile(r"header|search\w*|notices?|alerts?|follow|foot|skip\w*|copyright|disclaimers?")
_BOX = frozenset("bar box wrap wrapper container content inner text message area block panel form field input button btn icon link links list toggle close info warning danger error success".split())
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment\w*|reply|replies|respond)(?=$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry\w*|main\w*|post\w*|text|story\w*|prose|page)(?=$|[\s_-])", re.I)
WHOLE = 0.3  #: share of the best score that an <article> or <main> around it must reach to take its place
HALF = 0.5  #: share of the page's prose that makes a block named as furniture a wrapper, and of the best score that keeps a doubtful sibling
CONTROL = 100  #: characters of text per control below which a doubtful block is a form
DEPTH = 512  #: open elements at most, as in browsers; what is nested deeper stands beside each other there
MENU_LINK = 40  #: mean characters of a link's text from which a list of links reads like references, not like a menu
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "depth", "good", "bad", "named", "doubtful", "score", "chars", "links", "anchors", "controls")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []  # children: nodes and strings, in page order
        self.depth = parent.depth + 1 if parent else 0
        self.good = self.bad = self.named = self.doubtful = False  # named: bad by its name alone
        self.score = 0.0
        self.chars = self.links = self.anchors = self.controls = 0

    def is_menu(self) -> bool:
        """Mostly links, and short ones."""
        return self.links > 0.6 * self.chars > 0 and self.links < MENU_LINK * max(self.anchors, 1)


def tokens(page: str) -> Iterator[tuple[int, int, str | None, str, str]]:
    """(start, end, kind, name, rest) of each mark-up token in page order, in time
    that grows with the page whatever it holds. ``kind`` is "/" for an end tag, ""
    for a start tag, "t" for literal text (``rest``), and None for what is skipped.
    A reader that sends a place goes on from there.

    Quotes hide a tag's end, as in browsers. Once they are out of step to the end
    of the page, tags end at the next ">".
    """
    at, quoted, n = 0, True, len(page)
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark, skip = ("-->", 4) if page[at + 2] == "-" else ("]]>", 9)
            close = page.find(mark, at + skip)
            end = n if close < 0 else close + 3
            on = yield at, end, "t" if skip == 9 else None, "", page[at + skip : n if close < 0 else close]
        elif page.startswith(("<!", "<?"), at):
            close = page.find(">", at)
            end = n if close < 0 else close + 1
            on = yield at, end, None, "", ""
        elif m := _NAME.match(page, at):
            rest = _REST.match(page, m.end()) if quoted else None
            if rest is not None:
                end, attributes = rest.end(), rest[1]
            else:
                quoted = False
                close = page.find(">", m.end())
                if close < 0:
                    return  # no tag ends any more: the rest is text
                end, attributes = close + 1, page[m.end() : close]
            on = yield at, end, m[1], m[2].lower(), attributes
        else:
            at += 1
            continue
        at = end if on is None else on


def parse(page: str) -> Node:
    """A forgiving tree: unclosed paragraphs, items and cells are closed where a
    browser would, stray end tags are dropped, raw elements are skipped whole."""
    root = here = Node("#root", None)
    at, n = 0, len(page)
    lower = None
    unclosed: set[str] = set()  # raw elements without an end in the rest of the page
    opened: Counter[str] = Counter()  # open elements by name

    def up_to(node: Node) -> Node:
        x = here
        while x is not node:
            opened[x.tag] -= 1
            x = x.parent
        return node

    reader, go_on = tokens(page), None
    while True:
        try:
            start, end, kind, tag, attributes = reader.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at:
            here.children.append(_html.unescape(page[at:start]))
        at = end
        if kind == "t":
            here.children.append(attributes)
        if kind is None or kind == "t":
            continue
        if kind:
            if not opened[tag]:
                continue
            node = here
            while node is not root and node.tag != tag:
                if tag in _INLINE and node.tag in _BLOCK:
                    break
                if node.tag in ("table", "article", "body") and tag not in ("html", "body", "article", "main", "section", "div", "table"):
                    break
                node = node.parent
            if node is not root and node.tag == tag:
                here = up_to(node.parent)
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                lower = lower or page.lower()
                found = -1 if tag in unclosed else lower.find(f"</{tag}", at)
                if found < 0:
                    unclosed.add(tag)
                    at = n if tag in ("script", "style", "textarea", "title") else at
                else:
                    close = page.find(">", found)
                    at = n if close < 0 else close + 1
                go_on = at
            continue
        if (closes := _CLOSES.get(tag)) is not None:
            scope, node = _SCOPE.get(tag, ()), here
            while node is not root and node.tag not in scope:
                if node.tag in closes:
                    here = up_to(node.parent)
                elif node.tag not in _INLINE and node.tag not in closes:
                    break
                node = node.parent
        if tag == "body" or tag == "html":
            continue
        node = Node(tag, here)
        if attributes:
            _judge(node, attributes)
        if tag in _FURNITURE or (tag == "header" and not _inside(here, "article", "main")):
            node.bad, node.named = True, False
        here.children.append(node)
        if tag not in _VOID and not (attributes.endswith("/") and tag not in _BLOCK) and node.depth < DEPTH:
            here = node
            opened[tag] += 1
    if at < n:
        here.children.append(_html.unescape(page[at:]))
    return root


def _inside(node: Node | None, *tags: str) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _judge(node: Node, attributes: str) -> None:
    names = []
    for a in _ATTR.finditer(attributes):
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key in ("hidden",) or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
            node.bad = True
        elif key == "role":
            node.bad |= value.lower() in _ROLES
            node.good |= value.lower() in ("main", "article")
        elif key == "itemprop":
            node.good |= value == "articleBody"
        elif key in ("id", "class"):
            names.append(re.sub(r"([a-z])([A-Z])", r"\1-\2", value))
    name = " ".join(names)
    if name and node.tag not in _INLINE:
        node.good |= bool(_GOOD.search(name))
        blames = {_blame(x) for x in name.lower().split()}
        if node.tag not in ("article", "main", "p") and "bad" in blames or node.tag == "article" and _COMMENTS.search(name):
            node.named = not (node.bad or _COMMENTS.search(name))
            node.bad = True
        node.doubtful = "doubtful" in blames
    elif name and _BAD.search(name) and node.tag in ("span", "a", "small"):
        node.bad |= bool(re.search(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|share\w*|social\w*|skip\w*)(?=$|[\s_-])", name, re.I))


def _blame(name: str) -> str:
    """What one name says of its block: "bad", "doubtful" or nothing."""
    if not _BAD.search(name):
        return "doubtful" if _DOUBTFUL.search(name) else ""
    parts = [x for x in re.split(r"[-_]+", name) if x]
    at = [i for i, x in enumerate(parts) if _SUBJECT.fullmatch(x)]
    if not at or _BAD.search("-".join(x for i, x in enumerate(parts) if i not in at)):
        return "bad"
    if "header" in parts:
        return "bad" if {"site", "global", "top"}.intersection(parts) else "doubtful"
    after = parts[at[-1] + 1 :]
    return "doubtful" if any(x not in _BOX and not x.isdigit() for x in after) else "bad"


def _post_order(root: Node, named: bool = False) -> list[Node]:
    """The nodes that are no furniture, children first; with those ``named`` so, if asked."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        if not node.bad or named and node.named:
            todo.extend(c for c in node.children if c.__class__ is Node)
    return out[::-1]


def _spare_wrappers(root: Node) -> None:
    """A block named as furniture stays if it holds most of the page's prose and,
    as a sign that this is the article, a main heading or a declared article."""
    nodes = _post_order(root, named=True)
    if not any(n.named for n in nodes):
        return
    prose: dict[int, tuple[int, bool]] = {}
    for node in nodes:
        size, sign = 0, node.tag in ("h1", "article", "main") and (not node.bad or node.named)
        if (not node.bad or node.named) and node.tag != "a":
            for c in node.children:
                if c.__class__ is str:
                    size += len(c.strip())
                else:
                    more, holds = prose[id(c)]
                    size, sign = size + more, sign or holds
        prose[id(node)] = size, sign
    total = prose[id(root)][0]
    for node in nodes:
        size, sign = prose[id(node)]
        if node.named and sign and size > HALF * total:
            node.bad = node.named = False


def score(root: Node) -> list[Node]:
    """Measure all nodes bottom-up, then let paragraph-like blocks pass points up."""
    _spare_wrappers(root)
    nodes = _post_order(root)
    direct: dict[int, tuple[int, int]] = {}
    for node in nodes:
        if node.bad:
            continue
        chars = links = commas = own = 0
        for c in node.children:
            if c.__class__ is str:
                size = len(c.strip())
                chars += size
                own += size
                commas += c.count(",") + c.count("،") + c.count("、") + c.count("，")
                continue
            node.controls += c.controls + (c.tag in ("form", "input", "button"))
            if not c.bad:
                chars += c.chars
                links += c.links
                node.anchors += c.anchors
                if c.tag in _INLINE:
                    more = direct.get(id(c), (0, 0))
                    own += more[0]
                    commas += more[1]
        node.chars = chars
        node.links = chars if node.tag == "a" else links
        node.anchors += node.tag == "a"
        node.bad = node.doubtful and (links > 0.4 * chars or chars < CONTROL * node.controls)
        direct[id(node)] = (own, commas)
    for node in nodes:
        if node.bad or node.tag not in _SCORED:
            continue
        own, commas = direct[id(node)]
        if own < 20:
            continue
        points = (1 + commas + min(own / 100, 3)) * (1 - node.links / max(node.chars, 1))
        up, share = node.parent, 1
        while up is not None and share <= 5:
            up.score += points / share
            up, share = up.parent, share + 1
    for node in nodes:
        weight = {"article": 1.5, "main": 1.4}.get(node.tag, 1.0) * (1.25 if node.good else 1.0)
        node.score = 0.0 if node.bad else node.score * weight * (1 - node.links / max(node.chars, 1))
    return nodes


def _containers(root: Node) -> list[Node]:
    nodes = score(root)
    ranked = [n for n in nodes if n.tag in _BLOCK or n is root]
    best = max(ranked, key=lambda n: (n.score, n.chars), default=root)
    if best.score <= 0:  # no paragraph scored: the declared article, else all that is not furniture
        declared = [n for n in nodes if n.tag in ("article", "main") and not n.bad]
        best = max(declared, key=lambda n: n.chars, default=root)
    node = best
    while node is not None:  # a declared article counts as a whole where its own score comes near
        if node.tag in ("article", "main") and node.score >= WHOLE * best.score and (node.tag == "article" or node.chars <= 2 * best.chars + 200):
            best = node
        node = node.parent
    if best is root or best.parent is None:
        return [best]
    kept = []
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif c.__class__ is Node and not c.bad and c.tag in _BLOCK:
            density = c.links / max(c.chars, 1)
            near = c.score >= max(10.0, (HALF if c.doubtful else 0.2) * best.score)
            prose = c.tag == "p" and (c.chars > 80 and density < 0.25)
            title = c.tag == "h1" and best.tag != "article"
            if near or prose or title:
                kept.append(c)
    return kept


def text_of(containers: list[Node]) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            text = _SPACE.sub(" ", "".join(line)).strip()
            if text:
                blocks.append(text)
            line.clear()

    todo: list = list(reversed(containers))
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif item.__class__ is str:
            line.append(item)
        elif item.bad:
            continue
        elif item.tag == "br":
            line.append(" ")
        else:
            block = item.tag in _BLOCK
            if item.tag in ("ul", "div", "section") and item.is_menu():
                continue  # menus and related pages without a telling name
            if block:
                close()
                todo.append(None)
            todo.extend(reversed(item.children))
    close()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return text_of(_containers(parse(page)))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of every page."""
    fields = [f for f in pages.schema if f.name in keep]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    schema, out = arrow_schema(f"{ddl}, text string, n_chars long" if ddl else "text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name) for f in fields), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                schema=pa.schema([*(b.schema.field(f.name) for f in fields), out.field("text"), out.field("n_chars")]),
            )

    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, schema)
