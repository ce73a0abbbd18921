"""Main text of pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts. Repetitions in it are folded: like siblings that
follow one another, and stretches in which siblings recur. Then the streams of one host
are aligned one after another: where they agree, a part stays; what one lacks becomes
optional; where texts differ, the text becomes a slot. The result is the host's wrapper,
e.g. `nav- div ( # ) div ( h1 ( # ) ( p ( # ) )+ ) footer-`.

The wrapper says where the article is: the element that holds most of what fills slots,
repetitions first and links left out, summed over all pages of the host. Names of
elements and classes weigh in on that choice, and mark what within the article isn't of it.

Wrappers merge like the streams that they come from, and keep no text that varies. So
every task infers wrappers from its own pages, whatever their host; those of a host are
then merged in two steps: no page is moved for it, and a host with a third of all pages
has no more to merge in one task than others have.
"""

from __future__ import annotations

import html as html_lib
import json
import math
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import ship, stash

#: HTML's elements by their part in a page: fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd blockquote pre td th tr caption figcaption".split())
OUTSIDE = frozenset("nav header footer aside form head menu dialog button select option fieldset legend".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base col embed frame hr input keygen link meta param source track".split())
#: What a head may hold, the start tags that end an open p, those that end others, and what these don't reach beyond: fixed values.
HEAD = frozenset("head title base link meta".split())
ENDS_P = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table td th tr ul".split()
)
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")} | {f"h{i}": tuple(f"h{j}" for j in range(1, 7)) for i in range(1, 7)}
BOUNDS = frozenset("ul ol menu dir dl table".split())
#: Words of class and id attributes that mark what isn't the article: fixed values.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary contentinfo copyright cookie cookies consent disclaimer disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended recommendations related "
    "replies reply respond search share sharing sidebar signin signup social sponsor sponsored subscribe toolbar trending widget widgets".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:\s[^<>\"']*+(?:\"[^\"]*+\"|'[^']*+'))*+[^<>]*+)>"
    r"|</?[a-z][^<>]*+>|<[!?][^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+|[0-9]+")
#: Says of the element only that it stands beside such a thing.
_BESIDE = re.compile(r"\b(?:with|has|no|without)[-_][a-z]+", re.IGNORECASE)
_HIDDEN = re.compile(r"""\shidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)

#: Elements that only hold others; all other blocks are content, of which a repetition may have any mixture.
HOLDERS = frozenset("page html body div section article main nav header footer aside form center details dialog fieldset".split())
#: What holds all of a page.
WHOLE = frozenset("page html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements nested deeper than this are taken as parts of the one that deep, as browsers do from a depth of 512 on; their text stays.
DEPTH = 2000
#: Each level takes a few calls; Python's own limit would end at a depth of about 200.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * DEPTH))
#: Hosts of which a task holds wrappers at once.
HELD_HOSTS = 5_000
#: First merges of a host's wrappers, each in a task of its own.
SALTS = 32
#: Share of what fills an element's slots that another inside must have to be taken in its place.
DOMINANT = 0.6
#: By how much an article's name weighs more, and a word that marks something else weighs less.
NAMED = 8.0
#: Pages that must agree before they overrule such a word, or before constant texts around all slots count as the host's.
AGREED = 3

#: A node of a stream or a wrapper: its label (`#` for text, `*` for a repeated mixture of its parts), whether it
#: must stand, whether it repeats, a constant text, characters and those in links, its parts, and a page's blocks.
LABEL, LEAST, MANY, TEXT, CHARS, LINKS, PARTS, BLOCKS = range(8)
Node = list


def _node(label: str) -> Node:
    return [label, 1, False, None, 0, 0, [], None]


def host_of(url):
    """The host of a URL column in lower case, without port; pages without one share the host ''."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _zone(name: str, attrs: str, around: str) -> str:
    """'-' for an element outside the article, '+' for the article's own, '' for others. A header in an article is its heading."""
    if name in OUTSIDE and not (name == "header" and around == "+"):
        return "-"
    if attrs and name != "body" and name != "html":
        if _HIDDEN.search(attrs):
            return "-"
        for found in _NAMED.finditer(attrs):
            words = set(_PART.findall(_BESIDE.sub("", found[1] or found[2] or found[3] or "").lower()))
            if around == "+":
                words.discard("header")
            if not OUTSIDE_WORDS.isdisjoint(words):
                return "-"
            if "main" in words and name not in MAIN:
                return "+"
    return "+" if name in MAIN else ""


def stream(page: str | None) -> tuple[Node, list[str]]:
    """The page's tags as nested nodes, not yet folded, and its text blocks in order.

    Inline elements and line breaks don't end a block; character references are decoded,
    white space is one space each. End tags that HTML lets out are implied: a head ends at
    what it can't hold, p, li, dt, dd, cells and headings at what follows them. A label has
    `-` after what an element's name or an attribute puts outside the article, `~` after
    what only a word of its class or id does, `+` after the article's own. An article or
    main element in a form that wraps it is the article all the same.
    """
    page = page or ""
    root = _node("page")
    blocks: list[str] = []
    stack: list[tuple[str, Node, str, str]] = []  # open elements: name, node, the zone around, why it is outside the article
    open_: dict[str, int] = {}
    here, zone, text, links, in_link = root, "", [], 0, False
    at = 0

    def flush() -> None:
        nonlocal links
        if text:
            whole = "".join(text)
            text.clear()
            block = " ".join((html_lib.unescape(whole) if "&" in whole else whole).split())
            if block:
                found = ["#", 1, False, block if len(block) <= 80 else f"{block[:40]}...{xxhash.xxh3_64_hexdigest(block)}", len(block), min(links, len(block)), [], [len(blocks)]]
                here[PARTS].append(found)
                blocks.append(block)
        links = 0

    def leave(k: int) -> None:
        """Ends the open elements from the k-th on."""
        nonlocal here, zone
        for name, *_ in stack[k:]:
            open_[name] -= 1
        zone = stack[k][2]
        del stack[k:]
        here = stack[-1][1] if stack else root

    def close(names: tuple[str, ...], bounds: frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of these names, if nothing of `bounds` stands in between."""
        if not any(open_.get(n) for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return leave(k)
            if stack[k][0] in bounds:
                return

    def add(piece: str) -> None:
        nonlocal links
        if stack and stack[-1][0] == "head" and not piece.isspace():
            close(("head",))
        text.append(piece)
        if in_link:
            links += len(piece.strip())

    for found in _TOKEN.finditer(page):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        end = bool(found["end"])
        if not end and name not in HEAD and stack and stack[-1][0] in HEAD:
            flush()
            close(("head",))
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                in_link = not end
            continue
        flush()
        if end:
            close((name,))
            continue
        if stack:
            if name in ENDS_P and stack[-1][0] == "p":
                leave(len(stack) - 1)
            if name in ENDS:
                close(ENDS[name], BOUNDS)
        if name in VOID or found["attrs"].endswith("/"):
            continue
        attrs, why = found["attrs"], ""
        own = _zone(name, attrs, zone) if name not in LEAVES or attrs else ""
        if own == "-":
            why = "hidden" if _HIDDEN.search(attrs) else name if name in OUTSIDE else "word"
        elif own == "+" and zone == "-" and name in MAIN:  # a form may hold a whole page, and so may an element named like a part
            wraps = {"", "form", "word"} if name == "main" else {"", "form"}
            if all(w in wraps for _, _, _, w in stack):
                for _, node, _, _ in stack:
                    node[LABEL] = node[LABEL].rstrip("-~")
                zone = ""
        mark = "~" if why == "word" else own if name not in LEAVES or own == "-" else ""
        if len(stack) < DEPTH or own == "-":
            node = _node(name + mark)
            here[PARTS].append(node)
        else:
            node = here
        stack.append((name, node, zone, why))
        open_[name] = open_.get(name, 0) + 1
        here = node
        zone = "-" if zone == "-" or own == "-" else "+" if own == "+" else zone
    if at < len(page):
        add(page[at:])
    flush()
    return root, blocks


# -- folding and alignment ---------------------------------------------------------------------------------------------


def _holds(label: str) -> bool:
    return label.rstrip("+-~") in HOLDERS


def _labels(node: Node) -> set[str]:
    """What stands directly in a node, mixtures opened."""
    found = set()
    for part in node[PARTS]:
        if part[LABEL] == "*":
            found.update(x[LABEL] for x in part[PARTS])
        else:
            found.add(part[LABEL])
    return found


def _alike(x: Node, y: Node) -> float:
    """How well two nodes can be one: 0 to 1; elements that only hold others need half of what they hold in common."""
    a, b = x[LABEL], y[LABEL]
    if a == "*" or b == "*":
        return 1.0 if not {p[LABEL] for p in (x[PARTS] if a == "*" else [x])}.isdisjoint(p[LABEL] for p in (y[PARTS] if b == "*" else [y])) else 0.0
    if a != b:
        return 0.0
    if not x[PARTS] or not y[PARTS] or a[-1] == "+" or not _holds(a) or a in WHOLE:
        return 1.0
    p, q = _labels(x), _labels(y)
    share = len(p & q) / min(len(p), len(q))
    return 0.5 + share / 2 if share >= 0.5 else 0.0


def _same_kind(x: Node, y: Node) -> bool:
    """Whether siblings are rounds of one repetition."""
    if x[LABEL] != y[LABEL]:
        return False
    if not _holds(x[LABEL]) or x[LABEL][-1] in "+-":
        return True
    p, q = _labels(x), _labels(y)
    return 5 * len(p & q) >= 4 * len(p | q)


def _take_in(x: Node, y: Node) -> None:
    """y becomes a part of x."""
    if x[TEXT] != y[TEXT]:
        x[TEXT] = None
    x[CHARS] += y[CHARS]
    x[LINKS] += y[LINKS]
    if y[BLOCKS]:
        x[BLOCKS] = (x[BLOCKS] or []) + y[BLOCKS]
    if x[PARTS] or y[PARTS]:
        x[PARTS] = aligned(x[PARTS], y[PARTS])


def _again(x: Node, y: Node) -> None:
    """y is one more round of x."""
    x[LEAST], x[MANY] = max(x[LEAST], y[LEAST]), True
    _take_in(x, y)


def _mixture(nodes: list[Node]) -> Node:
    """A repetition of all these, each at most once among its parts."""
    parts: dict[str, Node] = {}
    for node in nodes:
        for part in node[PARTS] if node[LABEL] == "*" else [node]:
            if part[LABEL] in parts:
                _again(parts[part[LABEL]], part)
            else:
                parts[part[LABEL]] = part
            parts[part[LABEL]][LEAST] = 0
    mixed = _node("*")
    mixed[LEAST], mixed[MANY], mixed[PARTS] = max(n[LEAST] for n in nodes), True, list(parts.values())
    return mixed


def folded(nodes: list[Node]) -> list[Node]:
    """Siblings with repetitions folded; their parts are folded already.

    Like ones side by side become one that repeats. Where content recurs with nothing but
    content in between, or an element that only holds others for the third time, the
    stretch becomes a repeated mixture. An optional one of those that is like an earlier optional one is a
    round of it, wherever it stands: so a list has no more parts than kinds of parts.
    """
    out: list[Node] = []
    for x in nodes:
        label = x[LABEL]
        if out and label != "*" and _same_kind(out[-1], x):
            _again(out[-1], x)
            continue
        names = {p[LABEL] for p in x[PARTS]} if label == "*" else {label}
        holder = label != "*" and _holds(label)
        found, before = -1, 0
        for j in range(len(out) - 1, -1, -1):
            y = out[j]
            if y[LABEL] == "*":
                if holder:
                    if any(_same_kind(p, x) for p in y[PARTS]):
                        found = j
                elif not names.isdisjoint(p[LABEL] for p in y[PARTS]):
                    found = j
            elif _holds(y[LABEL]):
                if not holder or not _same_kind(y, x):
                    break
                before += 1
                if before == 2:
                    found = j
                    break
            elif y[LABEL] in names:
                found = j
        if found >= 0:
            out[found:] = [_mixture([*out[found:], x])]
        elif holder and not x[LEAST] and (like := next((y for y in out if not y[LEAST] and y[LABEL] == label and _alike(x, y)), None)) is not None:
            _again(like, x)
            like[LEAST] = 0
        else:
            out.append(x)
    return out


#: Pairs of siblings up to which all are weighed one by one; beyond it rows of pairs are weighed at once.
FEW_PAIRS = 4096


def _matches(p: list[Node], q: list[Node]) -> list[tuple[int, int]]:
    """The pairs of two lists that are one in the best alignment that keeps their orders."""
    n, m = len(p), len(q)
    first = 0
    while first < min(n, m) and p[first][LABEL] == q[first][LABEL] and _alike(p[first], q[first]) == 1.0:
        first += 1
    pairs = [(k, k) for k in range(first)]
    if first == n or first == m:
        return pairs
    p, q = p[first:], q[first:]
    best = _Best(p, q) if len(p) * len(q) > FEW_PAIRS else _FewBest(p, q)
    i = j = 0
    while i < len(p) and j < len(q):
        own, below = best.rows(i)
        w = best.worth(i, j)
        if w and own[j] == w + below[j + 1]:
            pairs.append((first + i, first + j))
            i, j = i + 1, j + 1
        elif own[j] == below[j]:
            i += 1
        else:
            j += 1
    return pairs


class _FewBest:
    """rows(i): the worth of the best alignment of p from i and from i + 1 on with q from each place on."""

    def __init__(self, p: list[Node], q: list[Node]):
        n, m = len(p), len(q)
        self.best = best = [[0.0] * (m + 1) for _ in range(n + 1)]
        self.each = worth = [[_alike(x, y) for y in q] for x in p]
        for i in range(n - 1, -1, -1):
            row, below, own = best[i], best[i + 1], worth[i]
            for j in range(m - 1, -1, -1):
                w = own[j]
                top = below[j] if below[j] >= row[j + 1] else row[j + 1]
                row[j] = w + below[j + 1] if w and w + below[j + 1] > top else top

    def rows(self, i: int) -> tuple[list[float], list[float]]:
        return self.best[i], self.best[i + 1]

    def worth(self, i: int, j: int) -> float:
        return self.each[i][j]


class _Best:
    """The same, a row at a time, in memory that grows with n + m and a root of n: every so many rows are kept, and those in between made again when they are asked for."""

    def __init__(self, p: list[Node], q: list[Node]):
        self.n, self.m = len(p), len(q)
        self.p, self.q = p, q
        self.inner, self.outer = _Sets(map(_labels, p), map(_labels, q)), _Sets(map(_outer, p), map(_outer, q))
        names = {x[LABEL]: None for x in (*p, *q)}
        number = {label: k for k, label in enumerate(names)}
        self.labels = np.array([number[y[LABEL]] for y in q])
        self.number, self.stars = number, np.array([y[LABEL] == "*" for y in q])
        self.bare = np.array([not y[PARTS] for y in q])
        self.step = max(1, math.isqrt(self.n))
        self.kept: dict[int, np.ndarray] = {self.n: np.zeros(self.m + 1)}
        row = self.kept[self.n]
        for i in range(self.n - 1, -1, -1):
            row = self._above(i, row)
            if i % self.step == 0:
                self.kept[i] = row
        self.block, self.between = -1, {}

    def _worth(self, i: int) -> np.ndarray:
        """_alike of p[i] with all of q."""
        x = self.p[i]
        label = x[LABEL]
        if label == "*":
            return (self.outer.shared(i) > 0).astype(np.float64)
        out = np.where(self.stars & (self.outer.shared(i) > 0), 1.0, 0.0)
        same = ~self.stars & (self.labels == self.number[label])
        if not x[PARTS] or label[-1] == "+" or not _holds(label) or label in WHOLE:
            return np.where(same, 1.0, out)
        share = self.inner.shared(i) / np.maximum(np.minimum(self.inner.sizes_p[i], self.inner.sizes_q), 1)
        return np.where(same, np.where(self.bare, 1.0, np.where(share >= 0.5, 0.5 + share / 2, 0.0)), out)

    def _above(self, i: int, below: np.ndarray) -> np.ndarray:
        w = self._worth(i)
        met = np.where(w > 0, w + below[1:], 0.0)
        return np.maximum.accumulate(np.append(np.maximum(below[:-1], met), 0.0)[::-1])[::-1]

    def rows(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        block = i // self.step
        if block != self.block:
            top = min((block + 1) * self.step, self.n)
            made = {top: self.kept[top]}
            for k in range(top - 1, block * self.step - 1, -1):
                made[k] = self._above(k, made[k + 1])
            self.block, self.between = block, made
        return self.between[i], self.between[i + 1]

    def worth(self, i: int, j: int) -> float:
        return _alike(self.p[i], self.q[j])


class _Sets:
    """How many labels two nodes' sets share, by rows of bits."""

    def __init__(self, p: Iterable[set[str]], q: Iterable[set[str]]):
        p, q = list(p), list(q)
        number = {label: k for k, label in enumerate(sorted(set().union(*p, *q)))}
        self.own = [[number[label] for label in x] for x in p]
        self.sizes_p, self.sizes_q = [len(x) for x in p], np.array([len(x) for x in q])
        places = [[] for _ in number]
        for j, x in enumerate(q):
            for label in x:
                places[number[label]].append(j)
        self.places = [np.array(x, np.int64) for x in places]
        self.m = len(q)

    def shared(self, i: int) -> np.ndarray:
        out = np.zeros(self.m, np.int64)
        for label in self.own[i]:
            out[self.places[label]] += 1
        return out


def _outer(node: Node) -> set[str]:
    return {x[LABEL] for x in node[PARTS]} if node[LABEL] == "*" else {node[LABEL]}


def _one(x: Node, y: Node) -> Node:
    """The node of which both are instances."""
    if x[LABEL] != y[LABEL] or x[LABEL] == "*":
        least = min(x[LEAST], y[LEAST])
        x = _mixture([x, y])
        x[LEAST] = least
        return x
    x[LEAST], x[MANY] = min(x[LEAST], y[LEAST]), x[MANY] or y[MANY]
    _take_in(x, y)
    return x


def aligned(p: list[Node], q: list[Node]) -> list[Node]:
    """The expression of both lists of siblings; what only one has is optional. Reuses the nodes of both."""
    out, i, j = [], 0, 0
    for a, b in [*_matches(p, q), (len(p), len(q))]:
        for lone in (*p[i:a], *q[j:b]):
            lone[LEAST] = 0
            out.append(lone)
        if a < len(p):
            out.append(_one(p[a], q[b]))
        i, j = a + 1, b + 1
    if len(out) == len(p) == len(q):
        return out
    return folded(out)


def _fold(node: Node) -> Node:
    label = node[LABEL]
    if label[-1] == "-":
        node[PARTS] = []
    else:
        node[PARTS] = folded([_fold(x) if x[LABEL] != "#" else x for x in node[PARTS]])
    return node


def wrapper_of(page: str | None) -> tuple[dict, list[str]]:
    """One page's wrapper, and its text blocks."""
    root, blocks = stream(page)
    return {"pages": 1, "root": _fold(root)}, blocks


def merge(a: dict | None, b: dict) -> dict:
    """The wrapper of both. Uses up a and b."""
    if a is None:
        return b
    return {"pages": a["pages"] + b["pages"], "root": _one(a["root"], b["root"])}


def _bare(node: Node) -> Node:
    """Without the blocks of the page that it comes from."""
    node[BLOCKS] = None
    for part in node[PARTS]:
        _bare(part)
    return node


def expression(wrapper: dict) -> str:
    """The wrapper as a union-free regular expression; `#` is a slot, quoted texts are constant."""

    def of(node: Node) -> str:
        own = "" if node[LABEL] == "*" else node[LABEL] if node[LABEL] != "#" else "#" if node[TEXT] is None else json.dumps(node[TEXT], ensure_ascii=False)
        if node[PARTS]:
            inside = " ".join(map(of, node[PARTS]))
            own = inside if not own else f"{own} ( {inside} )"
        suffix = ("+" if node[LEAST] else "*") if node[MANY] else ("" if node[LEAST] else "?")
        return f"( {own} ){suffix}" if suffix and (node[PARTS] or " " in own) else own + suffix

    return " ".join(map(of, wrapper["root"][PARTS]))


# -- where the article is ----------------------------------------------------------------------------------------------


class Article:
    """Which nodes of a wrapper are the article: `taken`, reached by way of `path`; `left` are the host's own texts around it."""

    def __init__(self, wrapper: dict):
        self.pages, self.root = wrapper["pages"], wrapper["root"]
        self.filled: dict[int, float] = {}
        self._fill(self.root, False)
        ways = self._descend()
        self.region = ways[-1]
        self.path, self.taken, self.left = {id(x) for x in ways}, {id(self.region)}, set()
        if len(ways) > 1:
            self.taken.update(id(x) for x in _opened(ways[-2][PARTS]) if x[LABEL][-1] == "+" and self.region[LABEL][-1] == "+")
        marked = self.region[LABEL][-1] == "+"
        headed = self._has_heading(self.region)
        for around, inner in zip(ways, ways[1:], strict=False):
            if not headed:
                self._headings(around, inner)
            if not marked and around[LABEL] not in WHOLE:  # content beside the inner element, within an outer one
                self.taken.update(id(x) for x in _opened(around[PARTS]) if not _holds(x[LABEL]) and self.filled[id(x)] > 0 and (self.pages == 1 or self._varies(x)))
        if self.region[LABEL] in WHOLE and self.pages >= AGREED:
            self._edges()

    def _weight(self, node: Node) -> float:
        mark = node[LABEL][-1]
        if mark == "~":
            return 1 / NAMED if self.pages >= AGREED else 0.0
        return 0.0 if mark == "-" else NAMED if mark == "+" else 1.0

    def _fill(self, node: Node, repeated: bool) -> float:
        """Characters outside links that fill slots, weighed; constant texts count a little, so that equal pages have an article."""
        if node[LABEL] == "#":
            own = (node[CHARS] - node[LINKS]) * (1.0 if node[TEXT] is None or self.pages == 1 else 0.1) * (1.0 if repeated else 0.5)
        else:
            inside = repeated or node[MANY] or node[LABEL] in HEADINGS
            own = sum(self._weight(x) * self._fill(x, inside) for x in node[PARTS])
        self.filled[id(node)] = own
        return own

    def _descend(self) -> list[Node]:
        """From the page to the innermost element that has most of what fills its slots, or to the first article."""
        ways = [self.root]
        while ways[-1][LABEL][-1] != "+":
            inside = [(self._weight(x) * self.filled[id(x)], x) for x in _opened(ways[-1][PARTS]) if _holds(x[LABEL])]
            if not inside:
                break
            most, best = max(inside, key=lambda x: x[0])
            if not most or most < DOMINANT * self.filled[id(ways[-1])]:
                break
            ways.append(best)
        return ways

    def _has_heading(self, node: Node) -> bool:
        return any(x[LABEL] in HEADINGS or (x[LABEL][-1] not in "-~" and self._has_heading(x)) for x in _opened(node[PARTS]))

    def _headings(self, around: Node, inner: Node) -> None:
        """Headings before an article without one of its own, alone or as all that an element holds, are its title."""
        for x in _opened(around[PARTS]):
            if x is inner:
                break
            if self._only_headings(x, self.pages > 1):
                self.taken.add(id(x))

    def _only_headings(self, node: Node, slots: bool) -> bool:
        if node[LABEL] in HEADINGS:
            return not slots or any(x[TEXT] is None for x in node[PARTS] if x[LABEL] == "#")
        return bool(node[PARTS]) and node[LABEL][-1] not in "-~" and all(self._only_headings(x, slots) for x in _opened(node[PARTS]))

    def _varies(self, node: Node) -> bool:
        return (node[LABEL] == "#" and node[TEXT] is None) or any(self._varies(x) for x in node[PARTS])

    def _edges(self) -> None:
        """Where no element holds the article, constant texts before the first and after the last slot are the host's, headings aside."""
        parts = _opened(self.region[PARTS])
        at = [i for i, x in enumerate(parts) if self._varies(x)]
        if at:
            self.left = {id(x) for x in [*parts[: at[0]], *parts[at[-1] + 1 :]] if x[LABEL] not in HEADINGS}

    def blocks(self, page: Node) -> list[int]:
        """The page's blocks that fall on the article, in order."""
        out: list[int] = []
        if id(self.root) in self.taken:
            self._collect_region(page, self.root, out)
        else:
            self._walk(page, self.root, out)
        return sorted(out)

    def _walk(self, page: Node, node: Node, out: list[int]) -> None:
        for x, y in _placed(_opened(page[PARTS]), _opened(node[PARTS])):
            if y is None:
                continue
            if id(y) in self.taken:
                if y is self.region and self.left:
                    self._collect_region(x, y, out)
                else:
                    self._collect(x, out)
            elif id(y) in self.path:
                self._walk(x, y, out)

    def _collect_region(self, page: Node, node: Node, out: list[int]) -> None:
        for x, y in _placed(_opened(page[PARTS]), _opened(node[PARTS])):
            if (y is None or id(y) not in self.left) and x[LABEL][-1] not in "-~":
                self._collect(x, out)

    def _collect(self, page: Node, out: list[int]) -> None:
        if page[BLOCKS]:
            out.extend(page[BLOCKS])
        for x in page[PARTS]:
            if x[LABEL][-1] not in "-~":
                self._collect(x, out)


def _opened(nodes: list[Node]) -> list[Node]:
    """Siblings, with the parts of mixtures in their place."""
    if not any(x[LABEL] == "*" for x in nodes):
        return nodes
    return [y for x in nodes for y in (x[PARTS] if x[LABEL] == "*" else (x,))]


def _placed(own: list[Node], nodes: list[Node]) -> Iterator[tuple[Node, Node | None]]:
    """Each of a page's siblings with the wrapper's node that it falls on: by alignment, else the first like it."""
    found = dict(_matches(own, nodes))
    for i, x in enumerate(own):
        yield x, nodes[found[i]] if i in found else next((y for y in nodes if _alike(x, y)), None)


def _marked(node: Node) -> set[int]:
    """The blocks within the page's own article and main elements."""
    out: set[int] = set()

    def walk(x: Node, inside: bool) -> None:
        if inside and x[BLOCKS]:
            out.update(x[BLOCKS])
        for y in x[PARTS]:
            if y[LABEL][-1] not in "-~":
                walk(y, inside or y[LABEL][-1] == "+")

    walk(node, False)
    return out


def main_text(page: str | None, article: Article | None) -> str:
    """The page's article by its host's wrapper, one line per block.

    A page of which nothing falls on the wrapper's article, or nothing of what it marks as
    its article itself, is its own wrapper; so is one without a host.
    """
    own, blocks = wrapper_of(page)
    if not blocks:
        return ""
    if article is not None:
        found = article.blocks(own["root"])
        if found and (not (marked := _marked(own["root"])) or not marked.isdisjoint(found)):
            return "\n".join(blocks[i] for i in found)
    return "\n".join(blocks[i] for i in Article(own).blocks(own["root"]))


# -- Spark -------------------------------------------------------------------------------------------------------------


def _rows(found: dict[str, dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())], ["host", "wrapper"])


def _of_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host, of rows that come host by host."""
    name, held = None, None
    for batch in batches:
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != name and held is not None:
                yield _rows({name: held})
                held = None
            name, held = own, merge(held, json.loads(text))
    if held is not None:
        yield _rows({name: held})


def infer(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """host, wrapper (JSON): one wrapper per host, from all of its pages. Pages without a host have none."""
    ship(pages.sparkSession)

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, _ = wrapper_of(page)
                _bare(own["root"])
                held[name] = merge(held.get(name), own)
            if len(held) > HELD_HOSTS:
                yield _rows(held)
                held = {}
        yield _rows(held)

    schema = "host string, wrapper string"
    parts = pages.where(F.col(host) != "").select(host, html).mapInArrow(of_pages, schema)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInArrow(_of_wrappers, schema)
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_of_wrappers, schema)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` with `text`, the main text of the whole HTML, in place of the HTML.

    Null and empty pages have the text ''. A page of a null or odd URL has no host and is
    its own wrapper. Repeated pages count as often as they stand, and have equal texts. A
    page and its wrapper meet by a join on the host, whose frequent hosts Spark can split.
    All other columns stay; one named text is replaced. An empty table gives an empty one.
    """
    pages = pages.drop(*({"text"} - {html, url})).withColumn("__host", host_of(F.col(url)))
    wrappers = stash(infer(pages, "__host", html), "wrappers").withColumnsRenamed({"host": "__host", "wrapper": "__wrapper"})
    others = [c for c in pages.columns if c not in (html, "__host")]
    rows = pages.join(wrappers, "__host", "left").select(*others, "__host", "__wrapper", html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Article] = {}
        for batch in batches:
            texts = []
            for name, text, page in zip(*[batch.column(len(others) + i).to_pylist() for i in range(3)], strict=True):
                if text is not None and name not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[name] = Article(json.loads(text))
                texts.append(main_text(page, known[name] if text is not None else None))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string())], [*others, "text"])

    schema = T.StructType([*(pages.schema[c] for c in others), T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema)


def op2_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
