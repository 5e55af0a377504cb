"""A small tolerant tree of a page's blocks, and the matching of two such trees."""

from __future__ import annotations

import html
import json
import math
import re
from bisect import bisect_left

import numpy as np

#: A tag that ends; every part takes all it can at once, so an attempt that fails costs its length once.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<[!?][^>]*+>", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr".split())
#: Start tags that end an open paragraph, and siblings that end each other.
ENDS_P = frozenset("address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    """A block element; ``parts`` are its child blocks and its own pieces of text in order."""

    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.parts = tag, attrs, []

    @property
    def blocks(self) -> list["Node"]:
        return [p for p in self.parts if isinstance(p, Node)]

    def words(self, *names: str) -> list[str]:
        """Lower-case words of the values of the named attributes."""
        found = []
        for name, *values in _ATTRIBUTE.findall(self.attrs):
            if name.lower() in names:
                found += re.findall(r"[a-z0-9]+", html.unescape("".join(values)).lower())
        return found

    def has(self, name: str) -> bool:
        return any(a[0].lower() == name for a in _ATTRIBUTE.findall(self.attrs))

    @property
    def label(self) -> str:
        return " ".join([self.tag, *sorted(set(self.words("class")))])

    def own_text(self) -> str:
        return " ".join(" ".join(p for p in self.parts if isinstance(p, str)).split())


class _Ends:
    """Where a tag ends whose attributes begin at a place: at the next > outside quotes. Made in one pass over the page."""

    def __init__(self, page: str):
        self.places = [m.start() for m in _SPECIAL.finditer(page)]
        self.ends, later = [-1] * (len(self.places) + 1), {}
        for i in range(len(self.places) - 1, -1, -1):
            c = page[self.places[i]]
            self.ends[i] = self.places[i] if c == ">" else self.ends[later[c] + 1] if c in later else -1
            later[c] = i

    def after(self, place: int) -> int:
        return self.ends[bisect_left(self.places, place)]


class _Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of any of the tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        for node in self.stack[place:]:
            self.places[node.tag].pop()
        del self.stack[place:]


def _tags(page: str):
    """(start, end, closing, lower-case name or empty for comments and declarations, attributes) of each tag, in time that
    grows with the page whatever it holds."""
    at, last, ends = 0, page.rfind(">"), None
    while True:
        at = page.find("<", at)
        if at < 0 or at > last and not page.startswith("<!--", at):
            return
        m = _TAG.match(page, at) if ends is None else None
        if m:
            start, at = at, m.end()
            at = max(at, (yield start, at, m[1], (m[2] or "").lower(), m[3] or "") or 0)
            continue
        name = _NAME.match(page, at)
        if ends is None and name:
            ends = _Ends(page)  # from the first tag that doesn't end on
        if name and (end := ends.after(name.end())) >= 0:
            start, at = at, end + 1
            at = max(at, (yield start, at, name[1], name[2].lower(), page[name.end() : end]) or 0)
            continue
        m = None if name else _TAG.match(page, at)  # a comment or declaration
        if m:
            start, at = at, m.end()
            at = max(at, (yield start, at, m[1], (m[2] or "").lower(), m[3] or "") or 0)
        else:
            at += 1


def parse(page: str) -> Node:
    """The tree of a page. Inline tags vanish, a line break is white space, raw elements (scripts, styles) go."""
    root = Node("#root")
    open_, at, size, last = _Open(root), 0, len(page), page.rfind(">")
    stack = open_.stack

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(html.unescape(piece) if "&" in piece else piece)

    buffer: list[str] = []
    tags, skip = _tags(page), None
    while True:
        try:
            start, end, closing, name, attributes = tags.send(skip)
        except StopIteration:
            break
        skip = None
        buffer.append(page[at:start])
        at = end
        if not name or name in INLINE:
            continue
        if name in ("br", "wbr"):
            buffer.append(" " if name == "br" else "")
            continue
        text("".join(buffer))
        buffer = []
        if closing:
            if place := open_.last((name,)):
                open_.close(place)
            elif name == "p":  # as browsers do, an empty paragraph
                stack[-1].parts.append(Node("p"))
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(page, at) if at <= last else None
                at = skip = found.end() if found else size
            continue
        if name in ENDS_P:
            place = open_.last(("p",))
            if place > open_.last(("table", "td", "th", "button", "object")):
                open_.close(place)
        if name in SIBLINGS:
            place = open_.last(SIBLINGS[name])
            if place > open_.last(SCOPES[name] - SIBLINGS[name]):
                open_.close(place)
        node = Node(name, attributes)
        stack[-1].parts.append(node)
        if name not in VOID and not attributes.endswith("/"):
            open_.push(node)
    buffer.append(page[at:])
    text("".join(buffer))
    return root


class Slot:
    """A node of the tree that is matched: a block, or neighbouring blocks of one label as one repeated slot."""

    __slots__ = ("label", "children", "nodes", "number")

    def __init__(self, label: str, nodes: list[Node], children: list["Slot"]):
        self.label, self.nodes, self.children, self.number = label, nodes, children, -1


def _neighbours(nodes: list[Node]) -> list[Slot]:
    out: list[Slot] = []
    for n in nodes:
        label = n.label
        if out and out[-1].label == label:
            out[-1].nodes.append(n)
        else:
            out.append(Slot(label, [n], []))
    return out


def slots(nodes: list[Node]) -> list[Slot]:
    """Slots of consecutive siblings; the children of a repeated slot are those of all its blocks."""
    out = _neighbours(nodes)
    left = list(out)
    while left:
        s = left.pop()
        s.children = _neighbours([c for n in s.nodes for c in n.blocks])
        left += s.children
    return out


def skeleton(page: Node) -> str:
    """The slots of a page as text: depths and labels in page order."""
    shape, left = [], [(1, s) for s in reversed(slots(page.blocks))]
    while left:
        depth, s = left.pop()
        shape.append((depth, s.label))
        left += [(depth + 1, c) for c in reversed(s.children)]
    return json.dumps(shape, ensure_ascii=False)


def wrapper(text: str) -> Slot:
    """Slots from a skeleton, numbered in order."""
    path = [Slot("#root", [], [])]
    path[0].number = 0
    for number, (depth, label) in enumerate(json.loads(text), 1):
        s = Slot(label, [], [])
        s.number = number
        del path[depth:]
        path[-1].children.append(s)
        path.append(s)
    return path[0]


def _shapes(*roots: Slot) -> tuple[dict[int, int], list[str], list[tuple[int, ...]], list[int], list[int]]:
    """Equal subtrees share a number: of each slot's identity, and by number the label, the children, the size and the height."""
    order = list(roots)
    for s in order:  # grows while it is read: parents before children
        order += s.children
    numbers: dict[tuple, int] = {}
    of: dict[int, int] = {}
    labels, kids, sizes, heights = [], [], [], []
    for s in reversed(order):
        below = tuple(of[id(c)] for c in s.children)
        n = of[id(s)] = numbers.setdefault((s.label, below), len(labels))
        if n == len(labels):
            labels.append(s.label)
            kids.append(below)
            sizes.append(1 + sum(sizes[c] for c in below))
            heights.append(1 + max((heights[c] for c in below), default=0))
    return of, labels, kids, sizes, heights


class _Alignment:
    """The best alignment of two rows of children, whose weights are those of pairs of shapes; a row of the table at a time."""

    def __init__(self, xs: tuple[int, ...], ys: tuple[int, ...], weight: dict):
        self.xs, self.ys, self.weight = xs, ys, weight
        self.kinds, self.place = np.unique(np.array(ys, np.int64), return_inverse=True)
        self.gains: dict[int, np.ndarray] = {}

    def _gain(self, x: int) -> np.ndarray:
        if x not in self.gains:
            self.gains[x] = np.array([self.weight.get((x, y), 0) for y in self.kinds.tolist()], np.int32)
        return self.gains[x][self.place]

    def _row(self, above: np.ndarray, x: int) -> np.ndarray:
        row = above.copy()
        np.maximum(row[1:], above[:-1] + self._gain(x), out=row[1:])
        return np.maximum.accumulate(row)

    def best(self) -> int:
        row = np.zeros(len(self.ys) + 1, np.int32)
        for x in self.xs:
            row = self._row(row, x)
        return int(row[-1])

    def pairs(self) -> list[tuple[int, int]]:
        """Places of the aligned children. Some rows of the table are kept and those between them made again."""
        step = math.isqrt(len(self.xs)) + 1
        row, kept = np.zeros(len(self.ys) + 1, np.int32), []
        for i, x in enumerate(self.xs):
            if i % step == 0:
                kept.append(row)
            row = self._row(row, x)
        out, j = [], len(self.ys)
        for block in range(len(kept) - 1, -1, -1):
            rows = [kept[block]]
            for x in self.xs[block * step : (block + 1) * step]:
                rows.append(self._row(rows[-1], x))
            i = len(rows) - 1
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((block * step + i, j))
        return out


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the most pairs of equally labelled slots that keep order and parentage.

    Elements of any width are compared alike. Equal subtrees are matched whole and others once per pair of shapes.
    """
    if a.label != b.label:
        return 0, []
    of, labels, kids, sizes, heights = _shapes(a, b)
    top = of[id(a)], of[id(b)]
    asked, left = {top}, [top]
    while left:
        x, y = left.pop()
        if x == y:
            continue
        by_label: dict[str, list[int]] = {}
        for q in set(kids[y]):
            by_label.setdefault(labels[q], []).append(q)
        more = {(p, q) for p in set(kids[x]) for q in by_label.get(labels[p], ())} - asked
        asked |= more
        left += more
    weight: dict[tuple[int, int], int] = {}
    for x, y in sorted(asked, key=lambda pair: heights[pair[0]]):  # children before parents
        if x == y:
            weight[x, y] = sizes[x]
        elif len(kids[x]) == 1 and len(kids[y]) == 1:
            weight[x, y] = 1 + weight.get((kids[x][0], kids[y][0]), 0)
        else:
            weight[x, y] = 1 + (_Alignment(kids[x], kids[y], weight).best() if kids[x] and kids[y] else 0)
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    out, todo = [], [(a, b)]
    while todo:
        s, t = todo.pop()
        out.append((s, t))
        x, y = of[id(s)], of[id(t)]
        if x == y:
            todo += zip(s.children, t.children)
            continue
        if (x, y) not in chosen:
            chosen[x, y] = _Alignment(kids[x], kids[y], weight).pairs() if kids[x] and kids[y] else []
        todo += [(s.children[i], t.children[j]) for i, j in chosen[x, y]]
    return weight[top], out


def align(page: Node, reference: Slot) -> dict[int, Slot]:
    """Slots of the page by the number of the reference slot that each is matched with."""
    return {r.number: p for p, r in match(Slot("#root", [page], slots(page.blocks)), reference)[1]}
