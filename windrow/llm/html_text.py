"""Main-text extraction by scoring a page's tree.

Paragraphs earn points for their length and their commas and pass them to their
ancestors, ever less with distance; a container's points are discounted by its
share of link text; the best container is kept with those siblings that hold
enough points of their own. Subtrees whose tag, role or class says menu,
advert, form, comments and so on never score and are never printed, unless a class
name is on a part that holds the page itself.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import slim

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"br", "option", "body", "html", "head", "title", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Open elements that a start tag ends, and those beyond which it does not reach.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
DROP_TAG = frozenset("nav footer head script style noscript template button select option textarea iframe svg math canvas object applet audio video menu fieldset input label search title".split())
DROP_ROLE = frozenset("navigation banner contentinfo search alert menu menubar toolbar status".split())
#: Tags and roles that are judged by what they hold: a page may stand whole in a form.
DOUBT_TAG = frozenset("form aside dialog".split())
DOUBT_ROLE = frozenset("complementary form dialog alertdialog".split())
DROP_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored promo promoted promotion sidebar sidebars aside menu menus nav navbar navigation"
    " breadcrumb breadcrumbs crumbs footer foot masthead topbar comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets toolbar pagination pager paginator copyright legal login signin search searchbox skip outbrain taboola".split()
)
#: Unwanted words of parts that hold a page more often than others do.
MILD_NAME = frozenset("aside sidebar sidebars widget widgets legal copyright header promo promoted promotion".split())
#: A name that has one of these words beside an unwanted one says what the page is like, not what the part is.
NOT_NAME = frozenset("no not without with has have is hide hidden show enable enabled disable disabled layout".split())
#: Words that name a part of what the word before them names.
PART_NAME = frozenset(
    "area bar block body box button buttons btn card cards col column content container form group header holder icon icons inner item items label layer left link links list message"
    " navigation nav panel popup pane right row section slot space strip text title top bottom unit view widget wrap wrapper zone footer banner menu overlay module prompt policy notice consent".split()
)
#: With one of these names, "header" belongs to the article.
OWN_NAME = frozenset("article entry post story content".split())
GOOD_NAME = frozenset("article body content entry main page post story text blog".split())
PARAGRAPH = frozenset("p pre td blockquote".split())
KEEP = frozenset("html body article main".split())
#: Paragraph points that a line or two beside the page may have.
BARE = 5.0
#: Tags that can be the best container.
HOLDER = frozenset("article main section div body td table dl ul ol center details".split())


class Node:
    __slots__ = ("tag", "parent", "names", "dropped", "named", "score", "points", "chars", "linked", "links", "kids", "commas", "order", "heads", "inside", "listed", "mild")

    def __init__(self, tag: str, parent: Node | None, names: frozenset, dropped: bool, order: int, named: bool = False, mild: bool = False):
        self.tag, self.parent, self.names, self.dropped, self.order, self.named, self.mild = tag, parent, names, dropped, order, named, mild
        self.score = self.points = 0.0
        self.chars = self.linked = self.links = self.commas = 0
        self.heads = int(tag in ("h1", "main"))
        self.inside = self.listed = False
        self.kids: list[Node] = []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


def _unwanted(tag: str, attrs: dict[str, str], names: frozenset, in_article: bool) -> bool:
    if tag in DROP_TAG:
        return True
    if tag in KEEP:
        return False
    if tag == "header":
        return not in_article
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in DROP_ROLE:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    return False


def _named(value: str, in_article: bool) -> bool:
    """Whether one of the names in an attribute says that the part is unwanted.

    A whole name or the last word of a compound ("site-footer", "comment-list" by its first) counts; a compound that negates
    or qualifies it ("no-sidebar", "with-comments", "social-science") does not.
    """
    for name in value.lower().split():
        words = _NAME.findall(name)
        if not words or set(words) & NOT_NAME and len(words) > 1:
            continue
        if words[-1] in DROP_NAME or words[0] in DROP_NAME and (len(words) == 1 or words[1] in PART_NAME or words[1].isdigit()):
            return True
        if "header" in (words[0], words[-1]) and not set(words) & OWN_NAME and not in_article:
            return True
    return False


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """A page's nodes and its (innermost block, text) blocks in page order, in time linear in the page.

    Subtrees unwanted by tag, role or style have no blocks; those unwanted by name are marked.
    """
    root = Node("#root", None, frozenset(), False, 0)
    nodes, stack, blocks = [root], [root], []
    #: places in the stack of each open tag, of blocks and of elements that an inline end tag does not cross
    opened: dict[str, list[int]] = {}
    block_at, wall_at = [0], [0]
    pieces: list[str] = []
    linked = link_depth = articles = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            whole = "".join(pieces)
            text = _SPACE.sub(" ", html.unescape(whole) if "&" in whole else whole).strip()
            if text:
                owner = stack[block_at[-1]]
                blocks.append((owner, text))
                owner.chars += len(text)
                owner.commas += text.count(",") + text.count("、") + text.count("，")
                owner.linked += min(len(text), linked)
            pieces.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal link_depth, articles
        while len(stack) > i:
            x = stack.pop()
            opened[x.tag].pop()
            link_depth -= x.tag == "a"
            articles -= x.tag in ("article", "main")
        while block_at[-1] >= i:
            block_at.pop()
        while wall_at[-1] >= i:
            wall_at.pop()

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1].dropped:
            pieces.append(piece)
            if link_depth:
                linked += len(piece.strip())

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag, closing, raw = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in BLOCK:
            flush()
        if closing:
            i = last((tag,))
            if i > 0 and (tag in BLOCK or wall_at[-1] <= i):
                if block_at[-1] >= i:
                    flush()
                pop_to(i)
            continue
        if tag in ENDS_P and stack[block_at[-1]].tag == "p":
            pop_to(block_at[-1])
        if tag in ENDS:
            ends, beyond = ENDS[tag]
            while (i := last(ends)) > max(0, last(beyond)):
                pop_to(i)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
        if tag in VOID:
            continue
        attrs = _attributes(raw)
        names = frozenset(_NAME.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())) if attrs else frozenset()
        parent = stack[-1]
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(page, at)
            at = end.end() if end else n
            continue
        named = tag not in KEEP and bool(attrs) and (_named(attrs.get("class", ""), articles > 0) or _named(attrs.get("id", ""), articles > 0))
        unwanted = _unwanted(tag, attrs, names, articles > 0)
        # an unwanted name drops an inline element at once; a block is judged by what it holds
        doubt = tag in DOUBT_TAG or attrs.get("role", "").lower() in DOUBT_ROLE and tag not in KEEP
        mild = tag in ("form", "aside") and not named or bool(names & MILD_NAME) and not names & (DROP_NAME - MILD_NAME)
        node = Node(tag, parent, names, parent.dropped or unwanted or named and tag not in BLOCK, len(nodes), (named or doubt) and tag in BLOCK, mild)
        if raw.endswith("/") and tag in ("svg", "path", "a"):
            continue
        nodes.append(node)
        parent.kids.append(node)
        opened.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            block_at.append(len(stack))
        if tag in ("table", "td", "article", "main", "body"):
            wall_at.append(len(stack))
        stack.append(node)
        articles += tag in ("article", "main")
        if tag == "a":
            link_depth += 1
            parent.links += 1
    flush()
    return nodes, blocks


def _drop_named(nodes: list[Node]) -> None:
    """Drops subtrees with an unwanted name, or of a doubtful tag or role, but for those that are the page itself.

    That is one with most of the page's paragraph points and a main heading, or with all points. Where no main heading
    and next to nothing stands outside such parts, the page is in them: then the mild ones stay, several together too.
    """
    whole = {id(x): (x.points, x.heads) for x in nodes}
    for x in reversed(nodes):
        if x.parent is not None:
            p, h = whole[id(x.parent)]
            q, g = whole[id(x)]
            whole[id(x.parent)] = (p + q, h + g)
    total = whole[id(nodes[0])][0]
    within: dict[int, bool] = {}
    outside, heads = 0.0, 0
    for x in nodes:  # parents come before their children
        within[id(x)] = x.named or x.parent is not None and within[id(x.parent)]
        if not within[id(x)] and not x.dropped:
            outside, heads = outside + x.points, heads + x.heads
    bare = not heads and outside <= min(BARE, total / 4)
    for x in nodes:
        if x.named:
            points, own = whole[id(x)]
            x.named = not (points > 0 and (points >= total or points > total / 2 and own or bare and x.mild))
        if (x.parent is not None and x.parent.dropped or x.named) and not x.dropped:
            x.dropped = True
        if x.dropped:
            x.points, x.chars, x.linked, x.commas = 0.0, 0, 0, 0


def extract(page: str | None) -> str:
    """The main text of one page: blocks in page order, joined by one space; empty if there is none."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    for node in nodes:
        if node.chars and (node.tag in PARAGRAPH or node.tag in ("div", "section", "article", "main", "li", "dd") and node.chars >= 25):
            node.points = 1 + node.commas + min(node.chars / 100, 3)
    _drop_named(nodes)
    blocks = [b for b in blocks if not b[0].dropped]
    if not blocks:
        return ""
    for node in nodes:
        points = node.points
        share, level, up = points, 0, node if node.tag not in PARAGRAPH else node.parent
        while points and up is not None and level < 6:
            up.score += share
            level += 1
            share = points / 2 if level == 1 else points / (3 * level)
            up = up.parent
    for node in reversed(nodes):  # whole text and link text of each subtree
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.links += node.links
            node.parent.commas += node.commas
    for node in nodes:
        bonus = {"article": 25, "main": 15}.get(node.tag, 0) if node.chars and not node.dropped else 0
        if node.tag in ("div", "section", "td"):
            bonus += 5 * bool(node.names & GOOD_NAME)
        node.score = 0 if node.dropped else (node.score + bonus) * (1 - min(1, node.linked / max(1, node.chars)))
    inner = [x for x in nodes if x.tag in HOLDER and x.chars]
    best = max(inner or nodes, key=lambda x: (x.score, -x.order))
    if best.score <= 0:
        best = nodes[0]
    kept = {id(best)}
    if best.parent is not None and best.tag != "body":
        for x in best.parent.kids:
            density = x.linked / max(1, x.chars)
            enough = x.score + (0.2 * best.score if x.names and x.names == best.names else 0) >= max(10, 0.2 * best.score)
            para = x.tag == "p" and (x.chars > 80 and density < 0.25 or 0 < x.chars <= 80 and x.linked == 0)
            if not x.dropped and (enough or para or x.tag == best.tag == "article" and x.score > 0):
                kept.add(id(x))
        follows = False
        for x in reversed(best.parent.kids):  # a main heading beside what is kept, and any heading right before it
            if x.tag == "h1" or x.tag in ("h2", "h3") and follows:
                if not x.dropped and x.chars and not x.linked:
                    kept.add(id(x))
            follows = id(x) in kept
    for x in nodes:  # parents come before their children
        if id(x) in kept:
            x.inside = True
        elif x.parent is not None:
            x.inside = x.parent.inside
            x.listed = x.parent.listed or x.tag in ("ul", "ol", "div", "section", "table") and x.links >= 3 and x.linked >= 0.7 * x.chars and x.commas < x.links - 1
    return " ".join(text for owner, text in blocks if owner.inside and not owner.listed)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds text and n_chars to each row of pages.

    A null, empty or textless page gives the empty text and 0. Each page is
    read whole, in time linear in its length; every row comes back once, repeated rows too; an empty
    table gives an empty one. Columns of pages named text or n_chars are replaced, others stay.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]

    @F.pandas_udf("string")
    def main_text(column):
        return column.map(extract)

    return slim(pages).withColumn("text", main_text(F.coalesce(F.col(html_col).cast("string"), F.lit("")))).withColumn("n_chars", F.char_length("text").cast("long")).select(*keep, "text", "n_chars")


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
