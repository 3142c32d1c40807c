"""Main text of web pages by tree scoring.

Paragraphs earn points for their length and commas and pass them to their
ancestors, less with each level; a container's points are discounted by the
share of its text that is links. The best container and those of its siblings
that score well are kept, without menus, forms, notices and the like in them.

The work is linear in the page: sums over elements are carried from the innermost
outwards once, and an open element knows its nearest relatives. A block's points reach
``LEVELS`` containers above it.

Edge cases: a null or empty page gives an empty text, a page that is cut off is
read as if its open elements ended there, what precedes any markup is text, of
containers with one score the innermost is the best, extra columns are ignored,
also those named like the result's, repeated pages are rows of their own.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.S | re.I,
)
# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav footer aside dialog menu input svg object select option optgroup noscript template annotation annotation-xml".split())
#: What they hold is no markup.
RAW = frozenset("script style textarea title iframe xmp".split())
#: They end in the tag itself if it says so, or if the page never closes them.
HOLLOW = RAW | frozenset("svg math object select noscript template".split())
#: A block ends them, unless they hold a document of their own.
BROKEN_BY_BLOCKS = frozenset(("svg", "math", "select"))
#: Dropped unless they hold most of the page's points, or its article.
FORMS = frozenset(("form", "fieldset"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = frozenset("ul ol dl table body html div section article td".split())
#: What an open element is looked up by: the nearest paragraph in its scope, foreign element, block, article, and what a list or table entry closes.
CLOSED = tuple(dict.fromkeys(CLOSES.values()))
CLOSABLE = frozenset().union(*CLOSED)
ENDS = SCOPE - {"td"}
#: How many ancestors of a block's container earn points by it; the last of them gets a 78th.
LEVELS = 40
#: Words in class, id and role that mark what is not the article.
UNLIKELY = frozenset(
    "header ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer "
    "gdpr hidden login masthead menu modal nav navbar navigation navigation-bar newsletter notice overlay pager pagination paywall popup promo promoted "
    "related recommended remark reply replies respond rss search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe "
    "tags teaser toolbar tooltip topbar widget alert announcement discussion feedback responses".split()
)
LIKELY = frozenset("article body content entry main post story text hentry".split())
#: Names of what is never the article, whatever its shape; other unlikely names ask for a look at the text.
FIRM = frozenset("ad ads adv advert advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr login masthead modal nav navbar newsletter pager pagination paywall shoutbox sidebar signup skip sponsored toolbar tooltip topbar".split())
#: Those that hold even beside a likely word, as in "entry-footer".
CERTAIN = frozenset("ad ads advert advertisement breadcrumb breadcrumbs comment comments cookie footer menu nav navigation newsletter promo related share sharing sidebar social sponsor sponsored subscribe".split())
REPLIES = frozenset("comment comments commentlist reply replies respond".split())
LISTS = frozenset("also contents latest links more next pages popular recent toc trending".split())
#: What can hold an article; lists, tables and quotations are parts of one.
CONTAINERS = frozenset("article body center dd details div fieldset form html main section td".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Characters from which a line is a paragraph, and entries of a list are no menu.
PROSE, ENTRY = 80, 40
#: "with-sidebar" says something of an element that is no sidebar.
BESIDE = frozenset("has with no without".split())
#: What stands at the foot of a page.
IMPRINT = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Node:
    __slots__ = ("article", "attrs", "block", "children", "closes", "container", "doubtful", "dropped", "foreign", "links", "number", "paragraph", "parent", "place", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, attrs: str, number: int):
        self.tag, self.parent, self.attrs, self.number = tag, parent, attrs, number
        self.children: list[Node] = []
        self.points, self.size, self.links = 0.0, 0, 0
        self.dropped = parent is not None and parent.dropped
        self.doubtful = False
        self.place = len(parent.children) if parent is not None else 0
        # The nearest element of a kind, itself included, so that no tag asks for a walk through all that is open.
        scope = tag in SCOPE
        above = parent
        self.block: Node = self if above is None or tag in BLOCK else above.block
        self.container: Node = self if above is None or tag in CONTAINERS else above.container
        self.article: Node | None = self if tag in ("article", "main") else above and above.article
        self.foreign: Node | None = self if tag in BROKEN_BY_BLOCKS or tag == "foreignobject" else above and above.foreign
        self.paragraph: Node | None = self if tag == "p" else None if scope else above and above.paragraph
        before = above.closes if above is not None else (None,) * len(CLOSED)
        if tag in ENDS or tag in CLOSABLE:
            before = tuple(self if tag in of else None if tag in ENDS else near for of, near in zip(CLOSED, before, strict=True))
        self.closes: tuple[Node | None, ...] = before


def _add_up(nodes: list[Node], values: list) -> list:
    """For each element the sum of ``values`` over it and all in it; elements come before what they hold."""
    for n in reversed(nodes):
        if n.parent is not None:
            values[n.parent.number] += values[n.number]
    return values


def _named(attrs: str) -> tuple[set[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    names: set[str] = set()
    hidden = bool(re.search(r"(?<![\w-])hidden(?![\w-])", re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", attrs)))
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            for one in value.split():
                words = {w.lower() for w in WORDS.findall(one)}
                names.update(words if not words & BESIDE else ())
            hidden |= key == "class" and "hidden" in value.split()
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
    return names, hidden


def _drops(node: Node) -> bool:
    if node.tag in ("html", "body"):
        return False
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and node.article is None:  # the page's, not the article's
        return True
    if not node.attrs:
        return False
    names, hidden = _named(node.attrs)
    if node.tag == "article" and names & REPLIES and not names & LIKELY:
        return True
    if hidden or node.tag in ("article", "main", *HEADINGS) or node.tag not in BLOCK:
        return hidden
    found = names & (CERTAIN if names & LIKELY else UNLIKELY)
    node.doubtful = bool(found) and not found & FIRM
    return bool(found & FIRM)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, list[tuple[str, bool]]]]]:
    """The elements of a page, and its blocks of text in page order: (innermost block element, pieces with "in a link")."""
    root = Node("html", None, "", 0)
    nodes, blocks = [root], []
    here, pieces, plain = root, [], 0  # plain: how many pieces there are up to the last that is text, and in no button or label
    opened: dict[str, list[Node]] = {"html": [root]}

    def end_block() -> None:
        nonlocal pieces, plain
        if plain:  # buttons and labels are words of a line only where its text goes on behind them
            blocks.append((here.block, pieces[:plain]))
        pieces, plain = [], 0

    def text(part: str) -> None:
        nonlocal plain
        control = opened.get("button") or opened.get("label")
        if control and not plain:
            return
        pieces.append((part, bool(opened.get("a"))))
        if not control and not part.isspace():
            plain = len(pieces)

    def leave(node: Node) -> None:
        nonlocal here
        while True:
            left, here = here, here.parent or root
            opened[left.tag].pop()
            if left is node:
                return

    last: dict[str, int] = {}

    def closed_after(tag: str, at: int) -> bool:
        """Whether a closing tag follows; each name is looked for once."""
        if tag not in last:
            last[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return last[tag] >= at

    at, m = 0, TOKEN.search(page)
    while m is not None:
        if m.start() > at and not here.dropped:
            text(page[at : m.start()])
        at = m.end()
        tag, close, attrs = (m["tag"] or "").lower(), m["close"], m["attrs"] or ""
        if tag in HOLLOW and not close:
            if attrs.endswith("/") or (tag not in ("script", "style") and not closed_after(tag, at)):
                tag = ""
            elif tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at) if closed_after(tag, at) else None
                at, tag = end.end() if end else len(page), ""
        m = TOKEN.search(page, at)
        if not tag:
            continue
        if tag in BLOCK:
            end_block()
        if close:
            up = opened[tag][-1] if opened.get(tag) else None
            if up is not None and up is not root and (tag in BLOCK or up.number > here.block.number):
                leave(up)
            continue
        if tag == "br":
            pieces.append((" ", bool(opened.get("a"))))
        if tag in VOID:
            continue
        if tag in BLOCK:  # an open paragraph ends here, with the inline elements left open in it
            foreign = here.foreign
            if foreign is None or foreign.tag != "foreignobject":
                if foreign is not None:
                    leave(foreign)
                if here.paragraph is not None:
                    leave(here.paragraph)
        if tag in CLOSES and (up := here.closes[CLOSED.index(CLOSES[tag])]) is not None:
            leave(up)
        if tag == "html":
            continue
        node = Node(tag, here, attrs, len(nodes))
        node.dropped = node.dropped or _drops(node)
        nodes.append(node)
        here.children.append(node)
        opened.setdefault(tag, []).append(node)
        here = node
    if at < len(page) and not here.dropped:
        text(page[at:])
    end_block()
    return nodes, blocks


def _drop_forms(nodes: list[Node], found: list[tuple[Node, str, int, float]]) -> None:
    """Marks what lies in forms that are no wrapper of the page's text."""
    if not any(n.tag in FORMS for n in nodes):
        return
    held = [0.0] * len(nodes)
    for owner, _, _, points in found:
        held[owner.number] += points
    _add_up(nodes, held)
    articles = _add_up(nodes, [int(n.tag in ("article", "main") and not n.dropped) for n in nodes])
    for n in nodes:
        if n.parent is not None:
            n.dropped |= n.parent.dropped or n.tag in FORMS and not articles[n.number] and 2 * held[n.number] <= held[0]


def _drop_named(nodes: list[Node], found: list[tuple[Node, str, int, float]]) -> None:
    """Marks blocks with an unlikely name that have no paragraph, many links, or comments in them."""
    if not any(n.doubtful for n in nodes):
        return
    size, links, prose = ([0] * len(nodes) for _ in range(3))
    for owner, line, linked, _ in found:
        if not owner.dropped:
            size[owner.number] += len(line)
            links[owner.number] += linked
            prose[owner.number] += len(line) >= PROSE
    for values in (size, links, prose):
        _add_up(nodes, values)
    own = [int(bool(n.attrs) and bool(_named(n.attrs)[0] & REPLIES)) for n in nodes]
    replies = _add_up(nodes, own.copy())
    for n in nodes:
        k = n.number
        if n.parent is not None:
            n.dropped |= n.parent.dropped or n.doubtful and (not prose[k] or replies[k] > own[k] or links[k] > 0.25 * size[k])


def _is_menu(node: Node, text: dict[int, str]) -> bool:
    """A list of links, unless its entries are long or a heading makes it one of the article's own."""
    if node.tag not in ("ul", "ol") or node.links <= 0.6 * node.size or len(node.children) <= 2:
        return False
    if node.size >= ENTRY * len(node.children):
        return False
    beside, at = (node.parent.children, node.place) if node.parent is not None else ([], 0)
    title = text.get(beside[at - 1].number, "") if at else ""
    if not at or beside[at - 1].tag not in HEADINGS:
        ordered = node.tag == "ol" and node.size >= 8 * len(node.children)
        return not (title.endswith(":") or ordered)
    return not title or bool({w.lower() for w in WORDS.findall(title)} & (UNLIKELY | LISTS))


def _plain_blocks(nodes: list[Node], beside: list[Node], lines: list[tuple[Node, str]]) -> set[int]:
    """Those divisions ``beside`` the best one that hold paragraphs and headings alone, and no imprint."""
    found = {n.number for n in beside if n.tag in ("div", "section") and not n.doubtful}
    if not found:
        return found
    other = [0] * len(nodes)
    for owner, line in lines:
        other[owner.number] += owner.tag not in ("p", "blockquote", *HEADINGS) or bool(IMPRINT.search(line))
    _add_up(nodes, other)
    return {k for k in found if not other[k]}


def main_text(page: str) -> str:
    nodes, blocks = parse(page)
    found = []
    for owner, parts in blocks:
        line = "" if owner.dropped else " ".join(entities.unescape("".join(p for p, _ in parts)).split())
        if line:
            linked = min(len(line), sum(len(p) for p, inside in parts if inside))
            found.append((owner, line, linked, 1 + line.count(",") + min(len(line) / 100, 3)))
    _drop_forms(nodes, found)
    _drop_named(nodes, found)
    lines: list[tuple[Node, str]] = []
    for owner, line, linked, points in found:
        if owner.dropped:
            continue
        lines.append((owner, line))
        up, level = owner.container, 1
        while up is not None and level <= 2 * LEVELS:
            up.points += points / level
            points *= 0.25 if up.doubtful else 1
            up, level = up.parent, level * 2 if level < 2 else level + 2
        owner.size += len(line)
        owner.links += linked
    if not lines:
        return ""
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.links += n.links
    score = {n.number: n.points * (1 - n.links / n.size) * (0.25 if n.doubtful else 1) for n in nodes if n.size}
    best = max((n for n in nodes if n.number in score and n.tag in CONTAINERS), key=lambda n: (score[n.number], n.number))
    up, whole = best, None
    while up is not None:  # an element that says it is the article holds all of it
        if up.tag in ("article", "main"):
            whole = up
            break
        up = up.parent
    best = whole or best
    kept = {best.number}
    least = max(3.0, 0.2 * score[best.number])
    for near in best.parent.children if best.parent is not None else ():
        dense = near.links > 0.25 * near.size
        if near.number in score and not dense and not near.doubtful and (score[near.number] >= least or near.tag in ("h1", "p") and near.size > 80):
            kept.add(near.number)
    beside = [n for n in best.parent.children if n.number in score or n is best] if best.parent is not None and not whole else [best]
    at = beside.index(best)
    plain = _plain_blocks(nodes, beside, lines)
    for step in (-1, 1):  # headings and paragraphs next to it, however short; no heading of what is not kept
        waiting: list[int] = []
        for near in beside[at + step :: step] if at + step >= 0 else ():
            if near.number in kept or near.links <= 0.25 * near.size and (near.tag == "p" or near.number in plain):
                kept.update((near.number, *waiting))
                waiting = []
            elif near.tag in HEADINGS and near.links <= 0.25 * near.size:
                if step < 0:
                    kept.add(near.number)
                else:
                    waiting.append(near.number)
            else:
                break
    text = {owner.number: line for owner, line in lines}
    shown: list[bool | None] = []  # of each element: not in what is kept (none), in a menu there (false), or shown
    for n in nodes:
        above = shown[n.parent.number] if n.parent is not None else None
        shown.append(True if n.number in kept else above and not _is_menu(n, text))
    return "\n".join(line for owner, line in lines if shown[owner.number])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "") for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = pages.select("page_id", "url", "html")
    kinds = dict(columns.dtypes)
    return columns.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
