"""Pages as trees of blocks: what wrapper induction aligns and what extraction takes its text from."""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

#: Fixed names of HTML: elements that begin a line of their own, that have no end, and that hold no markup.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: An element that begins ends open ones of the first set, unless one of the second lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th", "caption"}, {"table"}),
}
#: Elements, roles and words of classes and ids that say what is not the article.
ASIDE = frozenset("nav footer aside form button select dialog menu search object svg canvas audio video map template noscript fieldset datalist head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "nav navi navigation menu menus header headers masthead topbar toolbar footer footers sidebar sidebars aside rail cookie cookies consent gdpr notice notices banner banners alert alerts "
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor promo promos promotion comment comments disqus respond reply replies form forms login signup search share "
    "sharing social related recommended recommendations widget widgets popup modal overlay pagination pager skip hidden copyright disclaimer outbrain taboola".split()
)
STARTS = ("advert", "breadcrumb", "comment", "cookie", "footer", "navbar", "newsletter", "sidebar", "sponsor", "subscri")
#: Classes that only say that the page has such a part, and headers of articles.
LAYOUT, OWN = frozenset("has with without no layout".split()), frozenset("article entry post story content".split())
HINTS = frozenset("article articlebody content contents entry post story main maincontent".split())
#: Deeper elements count as part of the one that deep.
DEPTH = 200

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>")
TELLING = re.compile(r"class|\bid\b|role|hidden|style|itemprop", re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+))|\b(hidden)\b")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass(slots=True)
class Node:
    key: str
    children: list[Node] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Open:
    """An open element and what holds for all in it."""

    tag: str
    node: Node
    depth: int
    aside: bool = False  # by its element, role or attributes
    called: int = 0  # the outermost element whose class or id says so
    article: int = 0
    main: bool = False
    hints: tuple[int, ...] = ()
    link: bool = False
    skip: bool = False  # part of a line, and not the article's


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    aside: bool
    called: int
    article: int
    main: bool
    hints: tuple[int, ...]
    linked: int
    links: int
    slot: int = -1
    digest: int = 0


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if not TELLING.search(text):
        return found
    for name, a, b, c, bare in ATTRIBUTE.findall(text):
        found.setdefault((name or bare).lower(), a or b or c)
    return found


def _words(text: str) -> set[str]:
    return {w.lower() for w in WORD.findall(text)}


@lru_cache(4096)
def says_aside(name: str, in_article: bool) -> bool:
    """Whether one class or id names a part that is not the article."""
    words = _words(name)
    if words & LAYOUT:
        return False
    hits = {w for w in words if w in WORDS or w.startswith(STARTS)}
    return bool(hits - {"header", "headers"} if in_article or words & OWN else hits)


class Page:
    """The blocks of one page in order, and the tree they lie in."""

    def __init__(self, source: str) -> None:
        self.root = Node("")
        self.blocks: list[Block] = []
        self.stack = [Open("", self.root, 0)]
        self.open: dict[str, int] = {}
        self.lines = [0]  # places in the stack of elements that begin lines
        self.count = 0
        self.run: list[str] = []
        self.linked = self.links = 0
        self._read(source)
        self._flush()
        self.shape = json.dumps(self._collapsed(), ensure_ascii=False, separators=(",", ":"))

    # reading

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            lt = source.find("<", at)
            if lt < 0:
                self._text(source[at:])
                return
            if lt > at:
                self._text(source[at:lt])
            if source.startswith("<!--", lt):
                close = source.find("-->", lt + 4)
                at = end if close < 0 else close + 3
                continue
            name = NAME.match(source, lt)
            if not name:
                if source.startswith(("<!", "<?", "</"), lt):
                    close = source.find(">", lt)
                    at = end if close < 0 else close + 1
                else:
                    self._text("<")
                    at = lt + 1
                continue
            rest = REST.match(source, name.end())
            close = rest.end() if rest else source.find(">", name.end()) + 1  # quotes that never end
            if not close:
                return
            tag = name[2].lower()
            if name[1]:
                self._end(tag)
            else:
                self._begin(tag, source[name.end() : close - 1])
                if tag in RAW:
                    raw = RAW_END[tag].search(source, close)
                    close = raw.start() if raw else end
            at = close

    def _text(self, text: str) -> None:
        top = self.stack[-1]
        if top.skip:
            return
        if "&" in text:
            text = html.unescape(text)
        self.run.append(text)
        if top.link:
            self.linked += len(text.strip())

    def _flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                block = self.stack[self.lines[-1]]
                block.node.blocks.append(len(self.blocks))
                self.blocks.append(Block(text, block.tag, block.aside, block.called, block.article, block.main, block.hints, self.linked, self.links))
            self.run = []
        self.linked = self.links = 0

    def _pop(self) -> Open:
        gone = self.stack.pop()
        self.open[gone.tag] -= 1
        if self.lines[-1] == len(self.stack):
            self.lines.pop()
        return gone

    def _cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._pop()

    def _begin(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.run.append(" ")
        if tag in BLOCKS:
            self._flush()
            if self.open.get("head"):
                self._end("head")
            if self.stack[self.lines[-1]].tag == "p":
                self._cut(self.lines[-1])
            if tag in ENDS:
                ended, barrier = ENDS[tag]
                if any(self.open.get(t) for t in ended):
                    for depth in range(len(self.stack) - 1, 0, -1):
                        if self.stack[depth].tag in barrier:
                            break
                        if self.stack[depth].tag in ended:
                            self._cut(depth)
            if tag in ("html", "body"):  # the tree begins below them
                return
        elif tag == "a":
            if self.open.get("a"):
                self._end("a")
            self.links += 1
        if tag in VOID or tag in RAW or tag not in BLOCKS and tag not in ASIDE and tag != "a" and "=" not in rest and "hidden" not in rest:
            return
        self._open(tag, _attributes(rest))

    def _open(self, tag: str, attributes: dict[str, str]) -> None:
        up = self.stack[-1]
        self.count += 1
        names = (attributes.get("class", "") + " " + attributes.get("id", "")).split() if attributes else []
        new = Open(tag, up.node, up.depth + 1, up.aside, up.called, up.article, up.main, up.hints, up.link or tag == "a")
        role = attributes.get("role", "").lower()
        new.aside |= tag in ASIDE or tag == "header" and not up.article
        if attributes:
            new.aside |= role in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", "")))
        if tag != "main" and not new.called and any(says_aside(n, bool(up.article)) for n in names):
            new.called = self.count
        if (tag == "article" or role == "article") and not up.article:
            new.article = self.count
        new.main |= tag == "main" or role == "main" or attributes.get("itemprop") == "articleBody"
        if tag in BLOCKS:
            if not new.aside and any(_words(n) & HINTS for n in names):
                new.hints = (*up.hints, self.count)
            if new.depth <= DEPTH:
                new.node = Node(".".join([tag, *sorted(re.sub("[0-9]+", "", n) for n in names)]) if names else tag)
                up.node.children.append(new.node)
            self.lines.append(len(self.stack))
        else:
            new.skip = up.skip or new.aside != up.aside or new.called != up.called
        self.stack.append(new)
        self.open[tag] = self.open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if not self.open.get(tag):
            return
        while self._pop().tag != tag:
            pass

    # the tree

    def _collapsed(self) -> list:
        """The tree as nested [key, children]: like siblings in a row are one node, a repeated slot. Blocks
        get the number (in preorder) of their slot and the hash of all text of the slot."""
        numbers = iter(range(1 << 60))

        kinds: dict[tuple, int] = {}
        kind: dict[int, int] = {}
        kids: dict[int, list[list[Node]]] = {}
        order, todo = [], [self.root]
        while todo:
            order.append(todo.pop())
            todo.extend(order[-1].children)
        for node in reversed(order):
            runs: list[list[Node]] = []
            for child in node.children:
                if runs and kind[id(runs[-1][0])] == kind[id(child)]:
                    runs[-1].append(child)
                else:
                    runs.append([child])
            kids[id(node)] = runs
            kind[id(node)] = kinds.setdefault((node.key, *(kind[id(r[0])] for r in runs)), len(kinds))

        def emit(slot: list[Node]) -> list:
            number = next(numbers)
            own = [self.blocks[b] for node in slot for b in node.blocks]
            if own:
                text = "\n".join([b.text for b in own]).encode("utf-8", "surrogatepass")
                digest = int.from_bytes(blake2b(text, digest_size=8).digest(), "big", signed=True)
                for b in own:
                    b.slot, b.digest = number, digest
            parts: list[list] = []
            for members in zip(*(kids[id(node)] for node in slot), strict=True):
                parts.append(emit([n for run in members for n in run]))
            return [slot[0].key, parts]

        return emit([self.root])

    # the article

    def article(self) -> list[Block]:
        """The blocks of the page's main part, before the template of its host is taken off."""
        live = [b for b in self.blocks if not b.aside and not b.called]
        if not live:  # a page whose frame is called like a part of it
            around = {b.called for b in self.blocks if b.called and not b.aside and (b.article or b.main or b.tag == "h1")}
            live = [b for b in self.blocks if b.called in around and not b.aside]
        articles = {b.article for b in live if b.article}
        if articles:
            titled = {b.article for b in live if b.article and b.tag == "h1"} or articles
            return [b for b in live if b.article in titled]
        if any(b.main for b in live):
            return [b for b in live if b.main]
        slots: dict[int, list[int]] = {}
        for b in live:
            sums = slots.setdefault(b.slot, [0, 0, 0])
            for i, n in enumerate((len(b.text), b.linked, b.links)):
                sums[i] += n
        live = [b for b in live if not (slots[b.slot][2] >= 3 and slots[b.slot][1] >= 0.8 * slots[b.slot][0])]  # lists of links
        total = sum(len(b.text) for b in live)
        for hint in sorted({h for b in live for h in b.hints}):
            inside = [b for b in live if hint in b.hints]
            if 2 * sum(len(b.text) for b in inside) >= total:
                return inside
        return live
