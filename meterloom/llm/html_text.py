"""Main text of web pages by tree scoring.

A page becomes a tree. What is never article text (menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts, hidden parts) is cut off;
a container whose class or id only suggests that is weighed first (``_settle``).
Each paragraph then passes points for its length and commas to its ancestors,
less the further up; a container's points are discounted by the share of its
text that is links. The best container is kept, with those siblings that score
well or read like paragraphs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import prepare

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*))>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mstyle mpadded mphantom menclose mtable mtr mtd".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: An open element of the key's value ends when the key starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: The search for an open element stops here.
SCOPE = frozenset("table ul ol dl div article section main aside body html blockquote".split())
DROPPED = frozenset("nav header footer aside form button select input menu dialog object canvas head audio video annotation annotation-xml".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status tooltip".split())
#: Words of a class or id that tell what is not the article.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown "
    "footer form gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification offcanvas outbrain overlay pager pagination paywall "
    "popup promo promoted promotion recommend recommended related replies reply respond rss share sharing shoutbox sidebar signup skip skyscraper social sponsor sponsored subscribe "
    "subscription taboola tags toc toolbar topbar trackback widget widgets".split()
)
#: A class or id starting with one of these tells what a part has around it, not what it is.
MODIFIERS = frozenset("has no non not with without".split())
#: Words of a class or id that tell of the article.
LIKELY = frozenset("content main article post entry".split())
#: Containers that are weighed, not cut at once, for the words of their class or id.
WEIGHED = frozenset("div section table tbody tr td center".split())
KEPT = frozenset("html body article main".split())
CUT, DOUBTED, MIXED = 1, 2, 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption".split())
WORD = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Starting points of a container by its element.
START = {"article": 10.0, "main": 8.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0}
NEAR, LEAST_SIBLING = 0.2, 10.0


class Node:
    __slots__ = ("tag", "parent", "children", "score", "scored", "chars", "linked", "doubt")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.score, self.scored, self.chars, self.linked = 0.0, False, 0, 0
        self.doubt = 0


def _named(found: dict[str, str]) -> int:
    """What class and id tell: 0, ``DOUBTED``, or ``MIXED`` where one name tells of both the article and other parts."""
    doubted = mixed = False
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = WORD.findall(HUMP.sub(" ", name).lower())
        if not words or words[0] in MODIFIERS:
            continue
        likely = not LIKELY.isdisjoint(words)
        if UNLIKELY.isdisjoint(words):
            if likely:
                return 0
        elif likely:
            mixed = True
        else:
            doubted = True
    return MIXED if mixed else DOUBTED if doubted else 0


def _unwanted(tag: str, rest: str, names: bool = True) -> int:
    """0 or ``CUT``, by element, role or visibility; with ``names`` also by the words of class and id, then weighed containers get what ``_named`` says."""
    if tag in DROPPED:
        return CUT
    if not rest or tag in ("html", "body"):
        return 0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    if tag in KEPT:
        return names and _named(found)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return CUT
    if "style" in found and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found["style"].lower()):
        return CUT
    told = _named(found) if names and tag not in HEADINGS else 0
    return told if tag in WEIGHED else CUT if told else 0


def parse(page: str, names: bool = True) -> Node:
    """The page's tree without unwanted parts; unclosed and stray tags are tolerated. Without ``names``, class and id cut nothing."""
    root = Node("html", None)
    at, here = 0, root
    skipped: list[str] = []  # open elements inside an unwanted one, itself first
    last = page.rfind(">")
    inside = 0  # article or main elements open

    def text(value: str) -> None:
        if value and not skipped:
            here.children.append(html.unescape(value) if "&" in value else value)

    def close(tags, stop=SCOPE) -> None:
        nonlocal here, inside
        node = here
        while node is not root and node.tag not in tags:
            if node.tag in stop:
                return
            node = node.parent
        if node is root:
            return
        while here is not node.parent:
            inside -= here.tag in ("article", "main")
            here = here.parent

    while at <= last:
        m = MARKUP.search(page, at)
        if m is None:
            break
        text(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag, end, rest = m["tag"].lower(), bool(m["end"]), m["rest"]
        if tag in RAW and not end:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if stop is None and tag in ("script", "style", "textarea", "title"):
                at = len(page)
            elif stop is not None:
                at = stop.end()
            continue
        if skipped:
            if end:
                if tag in skipped:
                    del skipped[len(skipped) - 1 - skipped[::-1].index(tag) :]
                elif tag in ("body", "html"):
                    skipped.clear()
            elif tag in ("article", "main", "body") and skipped[0] in ("head", "nav", "header", "p"):
                skipped.clear()  # an unwanted part that was never closed
            elif tag not in VOID:
                if skipped[-1] == tag and tag in ("p", "li", "option", "tr", "td", "dt", "dd"):
                    continue
                skipped.append(tag)
            if skipped or end:
                continue
        if end:
            if tag == "p" or tag not in ("html", "body"):
                close({tag}, frozenset() if tag in SCOPE else SCOPE)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close({"p"})
                here.children.append(Node("hr", here))
            continue
        if tag in CLOSES_P:
            close({"p"})
        if tag in ENDS:
            close(ENDS[tag])
        if tag == "html":
            continue
        unwanted = _unwanted(tag, rest, names)
        if unwanted == CUT and tag == "header" and inside:
            unwanted = 0  # an article's own header: its headings count
        if unwanted == CUT:
            if not rest.rstrip().endswith("/") or tag not in ("input",):
                skipped.append(tag)
            continue
        node = Node(tag, here)
        node.doubt = unwanted
        here.children.append(node)
        here = node
        inside += tag in ("article", "main")
    if at < len(page):
        rest_text = page[at:]
        cut = rest_text.find("<") if re.search(r"<[a-zA-Z/!]", rest_text) else -1
        text(rest_text if cut < 0 else rest_text[:cut])
    _settle(root)
    return root


def _order(root: Node) -> list[Node]:
    """Nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.chars = node.linked = 0
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.linked += c.linked
            else:
                node.chars += len(" ".join(c.split()))
        if node.tag == "a":
            node.linked = node.chars


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _own_text(node: Node) -> str:
    """Text of a node and the inline elements in it."""
    parts, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag in INLINE:
            todo.extend(reversed(c.children))
    return " ".join("".join(parts).split())


def _best(root: Node) -> tuple[Node | None, float]:
    """The container with the best score."""
    nodes = _order(root)
    _measure(nodes)
    for node in nodes:
        node.score, node.scored = 0.0, False
    for node in nodes:
        direct = node.tag in PARAGRAPHS or node.tag not in INLINE and any(isinstance(c, str) and c.strip() for c in node.children)
        if not direct or node is root or node.tag in HEADINGS:
            continue
        said = _own_text(node)
        if not said:
            continue
        points = 1 + said.count(",") + said.count("，") + said.count("、") + min(len(said) / 100, 3.0)
        up, level = (node.parent if node.tag in PARAGRAPHS else node), 0
        while up is not None and level < 5:
            if not up.scored:
                up.scored, up.score = True, up.score + START.get(up.tag, 0.0)
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    best, best_score = None, float("-inf")
    for node in nodes:
        if node.scored:
            node.score *= 1 - _density(node)
            if node.score > best_score and node.tag not in INLINE:
                best, best_score = node, node.score
    return best, best_score


def _without(nodes: list[Node]) -> dict[int, tuple[Node, list]]:
    """Take nodes out of the tree; the former children of their parents."""
    gone = {id(n) for n in nodes}
    before = {id(n.parent): (n.parent, n.parent.children) for n in nodes}
    for parent, children in before.values():
        parent.children = [c for c in children if id(c) not in gone]
    return before


def _settle(root: Node) -> None:
    """Decide about the containers that class or id make doubtful.

    One around the page's main element stays, or around its articles if no
    undoubted article or main stands outside such containers. Of the others
    those with doubtful names only are taken out; one whose name also tells of
    the article stays if it holds the best container, or if without such ones
    less than half of the page's unlinked text would be left.
    """
    nodes = _order(root)
    doubts = [n for n in nodes if n.doubt and n.tag not in KEPT]
    if not doubts:
        return
    under: dict[int, Node | None] = {}  # the nearest doubtful container around
    for n in nodes:
        up = n.parent
        under[id(n)] = None if up is None else up if up.doubt and up.tag not in KEPT else under[id(up)]
    named = [n for n in nodes if n.tag == "main" or n.tag == "article" and not n.doubt]
    free = any(under[id(n)] is None for n in named)
    stays: set[int] = set()
    for n in named:
        if n.tag == "main" or not free:
            up = under[id(n)]
            while up is not None and id(up) not in stays:
                stays.add(id(up))
                up = under[id(up)]
    _without([n for n in doubts if n.doubt == DOUBTED and id(n) not in stays])
    if not any(n.doubt == MIXED and id(n) not in stays for n in doubts):
        return
    up, _ = _best(root)
    whole = root.chars - root.linked
    while up is not None:
        stays.add(id(up))
        up = up.parent
    before = _without([n for n in _order(root) if n.doubt == MIXED and n.tag not in KEPT and id(n) not in stays])
    _measure(_order(root))
    if 2 * (root.chars - root.linked) < whole:
        for parent, children in before.values():
            parent.children = children


def main_nodes(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    best, best_score = _best(root)
    if best is None:
        return [root]
    up = best
    while up is not root and up.tag not in ("article", "main", "body"):  # an article that holds it and little else
        up = up.parent
    if up.tag in ("article", "main") and _density(up) < 0.5:
        best = up
    if best.parent is None:
        return [best]
    kept = []
    for node in best.parent.children:
        if node is best:
            kept.append(node)
        elif isinstance(node, Node):
            dense = _density(node)
            if node.scored and node.score >= max(LEAST_SIBLING, NEAR * best_score) and dense < 0.5:
                kept.append(node)
            elif node.tag == "p" and (node.chars > 80 and dense < 0.25 or 0 < node.chars <= 80 and not node.linked and re.search(r"[.!?](\s|$)", _own_text(node))):
                kept.append(node)
            elif node.tag == "h1" and node.chars:
                kept.append(node)
    return kept


def blocks(node: Node) -> Iterator[str]:
    """Text of each block, in page order."""
    parts: list[str] = []
    todo: list[Node | str | None] = [node]
    while todo:
        item = todo.pop()
        if item is None or isinstance(item, Node) and item.tag not in INLINE:
            said = " ".join("".join(parts).split())
            if said:
                yield said
            parts = []
        if isinstance(item, str):
            parts.append(item)
        elif isinstance(item, Node):
            if item.tag == "header":
                found = [n for n in _order(item) if n.tag in HEADINGS]
                todo.append(None)
                todo.extend(reversed(found))
                continue
            if item.tag not in INLINE:
                todo.append(None)
            if item.tag in ("td", "th", "mtd"):
                parts.append(" ")
            todo.extend(reversed(item.children))
    said = " ".join("".join(parts).split())
    if said:
        yield said


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line; empty if there is none."""
    if not page:
        return ""
    for names in (True, False):  # again without the class filter if it leaves nothing
        said = "\n\n".join(b for node in main_nodes(parse(page, names)) for b in blocks(node))
        if said:
            break
    return said


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, where it is read.

    A null or empty page, or one without text, gives an empty text; repeated
    rows are extracted each; text without any markup is one block.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p) for p in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
