"""Main-text extraction with wrappers inferred as union-free regular expressions.

A page is a stream of balanced block tags, with their class or id, and of text slots. Streams of a host are aligned one after
the other into one expression over tags, slots, optional groups and repeated groups:
    a text mismatch makes a slot variable;
    a tag mismatch makes a repeat where the tokens before it complete a block that occurs again (its
    copies are folded), and otherwise an optional group up to the next common token.
Pages of one shape after folding only make slots variable; different shapes are aligned, in salted blocks of bounded size
whose expressions are merged, so a host with a third of all pages is pre-aggregated like any other.

A page is then read by its host's expression: the automaton of the expression binds every slot of the page to a slot of the
wrapper, and the texts bound to content slots are the main text. Whether a slot holds content is decided for the
wrapper, by a sum of evidence: how long its texts are, how much of them is links, whether they vary over the host's pages,
whether the slot lies in the element that holds most of the varying text, and, as a prior, what the tags and names on its
path say. Only what a browser doesn't show as text (scripts, titles, hidden parts) is left out by its tags alone.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Streams aligned in one task before their expressions are merged with those of other tasks.
BLOCK = 64
#: Page shapes whose expressions a task holds before it passes them on, and compiled wrappers that a task remembers.
SHAPES, HOSTS = 4096, 256
#: Evidence: prior by kind of slot; inside the main element, in its parent, outside an inferred and outside a marked one; long and
#: middling texts; a short text in a plain block beside prose; links; varying texts; template texts.
PRIOR = {"m": 2.0, "o": 0.0, "v": -1.0, "w": -3.0, "s": -7.0}
INSIDE, BESIDE, OUTSIDE, FAR, LONG, MIDDLE, SHORT_BLOCK, LINKS, VARIES, TEMPLATE = 2.0, 0.0, -2.5, -6.0, 2.0, 1.0, -3.0, -3.0, 0.5, -8.0
#: Words of a long, a middling and a short text; share of the text that makes an element the main one, and share of links.
LONG_WORDS, MIDDLE_WORDS, SHORT_WORDS, MAIN_SHARE, LINK_SHARE = 20, 8, 8, 0.6, 0.5
#: Different pages over which a text must be constant to be template text; words that tell a page from its copies.
PAGES, SIGN_WORDS = 3, 32
#: Characters up to which a constant text is kept in an expression as it is.
SHORT = 64

# Fixed values of HTML: void elements, raw-text elements, elements that break a line of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that aren't shown as running text; elements that mark what is beside the article; names that say the same.
UNSEEN = set("button select head script style noscript template iframe svg math textarea title object canvas audio video".split())
ASIDE = set("nav header footer aside form menu dialog".split())
SKIP_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus"
    " footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies"
    " search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Elements whose short texts are as good as long ones.
PROSE = set("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre figcaption address summary".split())
MAIN_TAGS, MAIN_WORDS = {"article", "main"}, {"main", "article"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.S)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_SPACED = re.compile(r"\S+")


def tokens(page: str) -> list[tuple]:
    """('<', name, words, hidden, whole names), ('>', name) and ('t', text) in page order; comments and raw text are left out."""
    out, at, n = [], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            out.append(("t", page[at:]))
            break
        if m.start() > at:
            out.append(("t", page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            out.append((">", name))
            continue
        words, hidden, whole = [], False, set()
        for key, a, b, c in _ATTR.findall(m[3]):
            if (key := key.lower()) in ("class", "id", "role"):
                words += _WORD.findall((a or b or c).lower())
                whole.update((a or b or c).lower().split())
            hidden |= key == "hidden" or key == "style" and "display:none" in (a or b or c).replace(" ", "").lower() or key == "aria-hidden" and (a or b or c) == "true"
        out.append(("<", name, tuple(words), hidden, frozenset(whole)))
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            out.append((">", name))
            at = end.end() if end else n
        elif name in VOID or m[3].endswith("/"):
            out.append((">", name))
    return out


# Elements whose open predecessor a new one closes, and where the search for it stops. Fixed values of HTML.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_IN_P = BLOCKS - {"body", "html", "head", "caption", "tbody", "td", "th", "tr", "thead", "tfoot", "option", "legend", "summary"}
_INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())


def _close(stack: list, names: set, stop: set) -> list[str]:
    """Drop the stack down to its last element of names, unless one of stop comes first; the block tags closed, innermost first."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in names:
            closed = [x[0] for x in stack[i:] if x[0] not in _INLINE]
            del stack[i:]
            return closed[::-1]
        if stack[i][0] in stop:
            break
    return []


def _label(step: tuple) -> str:
    return step[0] + ("." + ".".join(step[1]) if step[1] else "") + ("!" if step[2] else "")


def _kind(path: list) -> str | None:
    """What a slot's path says: m main region, v a name in it that may be boilerplate, s boilerplate, w perhaps, o nothing; None: not shown."""
    depth = max((i for i, step in enumerate(path) if step[0] in MAIN_TAGS), default=-1)
    main = strong = weak = False
    for i, (name, words, hidden, whole) in enumerate(path):
        if hidden or name in UNSEEN:
            return None
        if name in ("html", "body"):
            continue
        main |= name in MAIN_TAGS or not MAIN_WORDS.isdisjoint(words)
        strong |= name in ASIDE and not (name == "header" and i > depth >= 0) or i != depth and not SKIP_WORDS.isdisjoint(whole)
        weak |= i != depth and not SKIP_WORDS.isdisjoint(words)
    return "s" if strong else ("v" if main else "w") if weak else "m" if main else "o"


def stream(page: str) -> tuple[list[str], list[tuple]]:
    """(labels, pieces) of a page: balanced block tags and typed text slots, and the slots' texts.

    A label is "<tag", ">tag", or "#" with the slot's kind (see _kind). Elements that only
    mark up text are no labels, so a slot is a run of text of one kind between block tags. A piece is (slot number or -1 for
    blank text, kind, decoded text, whether a block boundary precedes it, words, words in links). Text that isn't shown is none.
    """
    labels: list[str] = []
    pieces: list[tuple] = []
    stack: list[tuple] = []
    run: list[tuple] = []
    kind, breaks, n, known = "", True, 0, True  # known: kind is that of the stack as it is

    def flush():
        nonlocal n, run, breaks
        if run:
            text = "".join(x for x, _ in run)
            if text.strip():
                labels.append("#" + kind)
                links = sum(len(_SPACED.findall(x)) for x, linked in run if linked)
                pieces.append((n, kind, text, breaks, len(_SPACED.findall(text)), links))
                n += 1
            else:
                pieces.append((-1, kind, text, breaks, 0, 0))
            run, breaks = [], False

    now: str | None = "o"
    linked = False

    def put(text):
        nonlocal kind, now, linked, known
        if not known:
            now, linked, known = _kind(stack), any(x[0] == "a" for x in stack), True
        if now is None:
            return
        if now != kind:
            flush()
            kind = now
        run.append((text, linked))

    for token in tokens(page):
        if token[0] == "t":
            put(entities.unescape(token[1]))
            continue
        name = token[1]
        if name == "br":
            if token[0] == "<":
                put(" ")
            continue
        known = False
        if name not in _INLINE:
            flush()
        if token[0] == "<":
            shut = _close(stack, {"p"}, BLOCKS - {"p"}) if name in _IN_P else []
            shut += _close(stack, *CLOSES[name]) if name in CLOSES else []
            labels += [">" + x for x in shut]
            stack.append((name, token[2], token[3], token[4]))
            if name not in _INLINE:
                labels.append("<" + _label(token[1:]))
        else:
            labels += [">" + x for x in (_close(stack, {name}, BLOCKS) if name in _INLINE else _close(stack, {name}, set()))]
        breaks |= name in BLOCKS
    flush()
    labels += [">" + x[0] for x in reversed(stack) if x[0] not in _INLINE]
    return labels, pieces


def constant(text: str) -> str:
    """What stands for a slot's text in an expression, where only equality matters: a long one by its digest."""
    words = " ".join(text.split())
    return words if len(words) <= SHORT else "\0" + xxhash.xxh3_128_hexdigest(words.encode("utf-8", "surrogatepass"))


def signs(*of: tuple) -> tuple:
    """The PAGES smallest of some pages' signs: enough to tell whether there are as many different pages."""
    return tuple(sorted(set().union(*of))[:PAGES])


def sign(pieces: list[tuple]) -> tuple:
    """What tells a page from its copies: the beginnings of the two longest texts of its article region, or of all texts if it has none."""
    own = sorted((p[2] for p in pieces if p[0] >= 0 and p[1] in "mv"), key=len)[-2:] or [p[2] for p in pieces if p[0] >= 0]
    if not own:
        return ()
    begun = "\n".join(" ".join(x.split(None, SIGN_WORDS)[:SIGN_WORDS]) for x in own)
    return (xxhash.xxh64_intdigest(begun.encode("utf-8", "surrogatepass")),)


# Expressions: lists of nodes. A node is a tag label, ('#', kind, constant or None, signs of pages, texts, words, words in
# links), ('?', expression) or ('+', expression).
def parse(labels: list[str], pieces: list[tuple]) -> list:
    page = sign(pieces)
    texts = iter([(constant(p[2]), page, 1, p[4], p[5]) for p in pieces if p[0] >= 0])
    return fold([("#", x[1:], *next(texts)) if x[0] == "#" else x for x in labels])


def _key(node):
    """What two nodes must share to align: equal tags, text slots of one kind, groups of the same shape."""
    if isinstance(node, str):
        return node
    return ("#", node[1]) if node[0] == "#" else (node[0], tuple(map(_key, node[1])))


def _same(a, b) -> bool:
    return a == b if isinstance(a, str) or isinstance(b, str) else a[0] == b[0] and _key(a) == _key(b)


def _join(a, b):
    """One node for two that are the same. A text mismatch makes the slot variable."""
    if isinstance(a, str):
        return a
    if a[0] == "#":
        return "#", a[1], a[2] if a[2] == b[2] else None, signs(a[3], b[3]), a[4] + b[4], a[5] + b[5], a[6] + b[6]
    return a[0], [_join(x, y) for x, y in zip(a[1], b[1])]


class _Shapes:
    """Numbers for shapes: equal numbers are equal shapes."""

    def __init__(self):
        self.known: dict = {}

    def of(self, *shape) -> int:
        return self.known.setdefault(shape, len(self.known))

    def node(self, node) -> int:
        if isinstance(node, str):
            return self.of(node)
        return self.of("#", node[1]) if node[0] == "#" else self.of(node[0], *_shapes(node[1], self))


def _items(nodes: list, shapes: _Shapes, close) -> tuple[list, list]:
    """(items, shapes): a sequence as whole elements and single nodes; close() makes an element's inner items and shapes final."""
    frames: list[tuple] = [([], [], None)]
    for node in nodes:
        if isinstance(node, str) and node[0] == "<":
            frames.append(([], [], node))
        elif isinstance(node, str) and len(frames) > 1 and frames[-1][2][1:].split(".")[0].rstrip("!") == node[1:]:
            items, own, start = frames.pop()
            items, own = close(items, own)
            frames[-1][0].append([start, *(x for item in items for x in item), node])
            frames[-1][1].append(shapes.of(start, *own, node))
        else:
            frames[-1][0].append([node])
            frames[-1][1].append(shapes.node(node))
    while len(frames) > 1:  # an element that doesn't end here, as in an optional group
        items, own, start = frames.pop()
        frames[-1][0].extend([[start], *items])
        frames[-1][1].extend([shapes.of(start), *own])
    return frames[0][0], frames[0][1]


def _shapes(nodes: list, shapes: _Shapes) -> list[int]:
    return _items(nodes, shapes, lambda items, own: (items, own))[1]


def fold(nodes: list) -> list:
    """Neighbouring copies of a block of whole elements become one repeated group, innermost and shortest blocks first."""
    shapes = _Shapes()

    def close(items: list, own: list) -> tuple[list, list]:
        size = 1
        while size <= len(own):
            keys = np.array(own)
            same = keys[size:] == keys[:-size]
            if not same.any() and not any(len(x) == 1 and not isinstance(x[0], str) and x[0][0] == "+" for x in items):
                size += 1
                continue
            out: list = []
            kept: list = []
            blocks: list = []  # the block's shapes of each repeated group in out, else None
            at = 0
            while at < len(own):
                block = own[at : at + size]
                last = blocks[-1] if blocks else None
                flat = [x for item in items[at : at + size] for x in item]
                if last == block:
                    out[-1] = [("+", list(map(_join, out[-1][0][1], flat)))]
                    at += size
                elif isinstance(items[at][0], str) and items[at][0][0] == "<" and len(items[at]) > 1 and block == own[at + size : at + 2 * size] and len(block) == size:
                    more = [x for item in items[at + size : at + 2 * size] for x in item]
                    out.append([("+", list(map(_join, flat, more)))])
                    kept.append(shapes.of("+", *block))
                    blocks.append(block)
                    at += 2 * size
                else:
                    out.append(items[at])
                    kept.append(own[at])
                    group = items[at][0]
                    blocks.append(_shapes(group[1], shapes) if len(items[at]) == 1 and not isinstance(group, str) and group[0] == "+" else None)
                    at += 1
            items, own, size = out, kept, size + 1
        return items, own

    items, own = _items(nodes, shapes, close)
    return [x for item in close(items, own)[0] for x in item]


def _meets(a: list, p: int, b: list, q: int) -> bool:
    """Nodes that can end an optional group: equal tags, or a repeat and one copy of its block."""
    x, y = a[p], b[q]
    if isinstance(x, str) and isinstance(y, str):
        return x == y
    for node, other, at in ((x, b, q), (y, a, p)):
        if not isinstance(node, str) and node[0] == "+" and at + len(node[1]) <= len(other) and all(map(_same, node[1], other[at : at + len(node[1])])):
            return True
    return not isinstance(x, str) and x[0] == "+" and _same(x, y)


def _places(nodes: list) -> dict:
    """Places of each label; a repeated group stands under ("+",) and under its block's first label."""
    out: dict = {}
    for i, x in enumerate(nodes):
        if isinstance(x, str):
            out.setdefault(x, []).append(i)
        elif x[0] == "+":
            out.setdefault(("+",), []).append(i)
            if isinstance(x[1][0], str):
                out.setdefault(x[1][0], []).append(i)
    return out


def _nearest(a: list, i: int, b: list, j: int, places: dict) -> tuple[int, int] | None:
    """The nodes from i and j on that meet after the fewest others, of equal ones the first in a; the search ends with the streams."""
    best, reach = None, len(a) - i + len(b) - j
    for p in range(i, len(a)):
        d = p - i
        if d >= reach:
            break
        x = a[p]
        if isinstance(x, str):
            keys = [x]
        elif x[0] == "+":
            keys = [("+",), *(x[1][:1] if isinstance(x[1][0], str) else [])]
        else:
            continue
        for key in keys:
            at = places.get(key, ())
            for q in at[bisect_left(at, j) :]:
                if d + q - j >= reach:
                    break
                if d + q - j > 0 and _meets(a, p, b, q):
                    best, reach = (p, q), d + q - j
                    break
    return best


def align(a: list, b: list) -> list:
    """The union-free expression of two expressions: common nodes joined, the rest repeated or optional."""
    out: list = []
    places = _places(b)
    i = j = 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if _same(x, y):
            out.append(_join(x, y))
            i, j = i + 1, j + 1
            continue
        # One side repeats what the other has once: a single block against its group.
        if not isinstance(x, str) and x[0] == "+" and all(map(_same, x[1], b[j : j + len(x[1])])) and j + len(x[1]) <= len(b):
            out.append(("+", list(map(_join, x[1], b[j : j + len(x[1])]))))
            i, j = i + 1, j + len(x[1])
            continue
        if not isinstance(y, str) and y[0] == "+" and all(map(_same, y[1], a[i : i + len(y[1])])) and i + len(y[1]) <= len(a):
            out.append(("+", list(map(_join, y[1], a[i : i + len(y[1])]))))
            i, j = i + len(y[1]), j + 1
            continue
        # An optional group aligns with its content, or is skipped.
        if not isinstance(x, str) and x[0] == "?" and j + len(x[1]) <= len(b) and all(map(_same, x[1], b[j : j + len(x[1])])):
            out.append(("?", list(map(_join, x[1], b[j : j + len(x[1])]))))
            i, j = i + 1, j + len(x[1])
            continue
        if not isinstance(x, str) and x[0] == "?":
            out.append(x)
            i += 1
            continue
        if not isinstance(y, str) and y[0] == "?":
            out.append(y)
            j += 1
            continue
        # The nearest common node ends an optional group on one or both sides.
        best = _nearest(a, i, b, j, places)
        if not best:
            break
        for group in (a[i : best[0]], b[j : best[1]]):
            if group:
                out.append(("?", group))
        i, j = best
    for group in (a[i:], b[j:]):
        if group:
            out.append(group[0] if len(group) == 1 and not isinstance(group[0], str) and group[0][0] == "?" else ("?", group))
    return fold(out)


def _pack(x) -> object:
    return x if isinstance(x, str) else [*x] if x[0] == "#" else [x[0], [_pack(y) for y in x[1]]]


def _unpack(x) -> object:
    return x if isinstance(x, str) else (*x[:3], tuple(x[3]), *x[4:]) if x[0] == "#" else (x[0], [_unpack(y) for y in x[1]])


class Wrapper:
    """A host's expression as an automaton over its tags and slots, which binds each slot of a page to one of its own."""

    def __init__(self, expression: list, shared: frozenset = frozenset(), pages: tuple = ()):
        self.nodes: list = [None]  # of each position; 0 is the start
        self.follow: list[dict] = [{}]
        first, last, empty = self._build(expression)
        self._link([0], first)
        self.last = set(last) | ({0} if empty else set())
        self.shared = shared if len(pages) >= PAGES else frozenset()
        self.evidence = self._weigh()

    def _link(self, before, after) -> None:
        for p in before:
            for q in after:
                label = self.nodes[q] if isinstance(self.nodes[q], str) else "#" + self.nodes[q][1]
                to = self.follow[p].setdefault(label, [])
                if q not in to:
                    to.append(q)

    def _build(self, nodes: list) -> tuple[list, list, bool]:
        """(first positions, last positions, whether it may be empty) of a sequence."""
        first, last, empty = [], [], True
        for node in nodes:
            if isinstance(node, str) or node[0] == "#":
                self.nodes.append(node)
                self.follow.append({})
                f, t, e = [len(self.nodes) - 1], [len(self.nodes) - 1], False
            else:
                f, t, e = self._build(node[1])
                if node[0] == "+":
                    self._link(t, f)
                e |= node[0] == "?"
            self._link(last, f)
            first = first + f if empty else first
            last, empty = last + t if e else t, empty and e
        return first, last, empty

    def bind(self, labels: list[str]) -> list[int] | None:
        """The position of each label, of several ways through the earliest; None if the expression has no such stream."""
        now, steps = {0: -1}, []
        for label in labels:
            to: dict[int, int] = {}
            for p in sorted(now):
                for q in self.follow[p].get(label, ()):
                    to.setdefault(q, p)
            if not to:
                return None
            steps.append(to)
            now = to
        at = min((p for p in now if p in self.last), default=None)
        if at is None:
            return None
        out = []
        for to in reversed(steps):
            out.append(at)
            at = to[at]
        return out[::-1]

    def _weigh(self) -> list[float]:
        """The evidence of each slot for being content, from its statistics over the host's pages; see the constants."""
        inside: list[tuple] = [()] * len(self.nodes)  # elements around a position, outermost first
        names, stack = {}, []
        for p, node in enumerate(self.nodes):
            if isinstance(node, str) and node[0] == "<":
                names[p] = node[1:].split(".")[0].rstrip("!")
                stack.append(p)
            elif isinstance(node, str):
                if any(names[x] == node[1:] for x in stack):  # an optional group may close what it doesn't open
                    while names[stack.pop()] != node[1:]:
                        pass
            elif node is not None:
                inside[p] = tuple(stack)
        slots = [p for p, node in enumerate(self.nodes) if node is not None and not isinstance(node, str)]
        fixed = lambda p: self.nodes[p][2] is not None and len(self.nodes[p][3]) >= PAGES
        mass: dict[int, float] = {}
        total = 0.0
        for p in slots:
            _, kind, _, _, _, words, links = self.nodes[p]
            if kind == "s" or fixed(p):
                continue
            own = (words - links) * (2 if kind == "m" else 0.5 if kind == "w" else 1)
            total += own
            for e in inside[p]:
                mass[e] = mass.get(e, 0.0) + own
        # Down from the root to the innermost element that still holds most of the text, or to one that is marked as the article.
        main, marked = None, False
        for e in sorted((e for e, m in mass.items() if total and m >= MAIN_SHARE * total)):
            if not marked:
                main, marked = e, names[e] in MAIN_TAGS or not MAIN_WORDS.isdisjoint(self.nodes[e][1:].rstrip("!").split(".")[1:])
        around = next((inside[p] for p in slots if main in inside[p]), ())
        parent = around[around.index(main) - 1] if main in around and around.index(main) else None
        within = [p for p in slots if main is None or main in inside[p]]
        prose = sum(self.nodes[p][5] for p in within) >= LONG_WORDS * max(1, sum(self.nodes[p][4] for p in within))
        out = [0.0] * len(self.nodes)
        for p in slots:
            _, kind, text, _, texts, words, links = self.nodes[p]
            mean = words / texts
            value = PRIOR[kind] + (LONG if mean >= LONG_WORDS else MIDDLE if mean >= MIDDLE_WORDS else 0.0)
            value += INSIDE if main is None or main in inside[p] else FAR if marked else BESIDE if parent in inside[p] else OUTSIDE
            value += LINKS if links > LINK_SHARE * words and kind != "m" else 0.0
            value += VARIES if text is None else 0.0
            block = names[inside[p][-1]] if inside[p] else ""
            value += SHORT_BLOCK if prose and mean < SHORT_WORDS and block not in PROSE and block else 0.0
            out[p] = value
        return out

    def content(self, position: int, text: str) -> bool:
        """Whether a slot's text belongs to the main text. Template text: constant over PAGES different pages, or shared by all."""
        _, kind, fixed, pages, *_ = self.nodes[position]
        template = fixed is not None and len(pages) >= PAGES or kind not in "mv" and constant(text) in self.shared
        return self.evidence[position] + (TEMPLATE if template else 0.0) > 0


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, expression, shared, n): one expression per host, and the texts outside articles that all its n pages have with signs of the pages, as JSON.

    Per task each host's pages are joined by shape as they stream by and the shapes are aligned, so what is shuffled is
    one expression per host and task; those are merged in blocks of BLOCK until a host has one.
    """
    import json

    schema = "host string, expression string, shared string, n long"

    def batch_of(rows):
        cols = list(zip(*((h, json.dumps([_pack(x) for x in e]), json.dumps([sorted(s), g]), n) for h, (e, s, g, n) in rows.items())))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 3 else pa.string()) for i, c in enumerate(cols)], names=["host", "expression", "shared", "n"])

    def first(batches):
        shapes: dict[str, dict] = {}
        rest: dict[str, list] = {}

        def aligned():
            out = {}
            for host, of in shapes.items():
                every = list(of.values())
                for e in every[1:]:
                    every[0] = align(every[0], e)
                out[host] = (every[0], *rest[host])
            return batch_of(out)

        held = 0
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                labels, pieces = stream(page.as_py() or "")
                nodes = parse(labels, pieces)
                own, key = {constant(p[2]) for p in pieces if p[0] >= 0 and p[1] not in "mv"}, tuple(map(_key, nodes))
                of = shapes.setdefault(host, {})
                if key in of:  # a page of known shape only makes slots variable
                    of[key] = list(map(_join, of[key], nodes))
                else:
                    of[key], held = nodes, held + 1
                if host in rest:
                    rest[host] = [rest[host][0] & own, signs(rest[host][1], sign(pieces)), rest[host][2] + 1]
                else:
                    rest[host] = [own, sign(pieces), 1]
            if held > SHAPES:
                yield aligned()
                shapes, rest, held = {}, {}, 0
        if shapes:
            yield aligned()

    def merge(table: pa.Table) -> pa.Table:
        got: dict[str, list] = {}
        for host, expression, shared, n in sorted(zip(*(table.column(c).to_pylist() for c in ("host", "expression", "shared", "n")))):
            e, (s, g) = [_unpack(x) for x in json.loads(expression)], json.loads(shared)
            got[host] = [align(got[host][0], e), got[host][1] & set(s), signs(got[host][2], g), got[host][3] + n] if host in got else [e, set(s), tuple(g), n]
        return pa.Table.from_batches([batch_of(got)])

    now = written(bounded_batches(pages.select(_host(url).alias("host"), F.col(html).cast("string").alias("html"))).mapInArrow(first, schema), "wrappers")
    while True:
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return now
        blocks = -(-most // BLOCK)
        salted = now.withColumn("salt", F.pmod(F.xxhash64("expression", "n"), F.lit(blocks)))
        now = written(salted.groupBy("host", "salt").applyInArrow(merge, schema), "wrappers", now)


def main_text(page: str, wrapper: Wrapper | None = None) -> str:
    """The article's blocks, one per line: texts of the content slots that the page binds in its host's wrapper.

    A page that the wrapper doesn't accept is read by the wrapper inferred from it alone. Blank text goes with the slot before it.
    """
    labels, pieces = stream(page)
    bound = wrapper.bind(labels) if wrapper else None
    if bound is None:
        wrapper = Wrapper(parse(labels, pieces))
        bound = wrapper.bind(labels) or []
    places = [p for p in bound if not isinstance(wrapper.nodes[p], str)]
    blocks: list[list[str]] = [[]]
    content = True
    for slot, _, text, breaks, _, _ in pieces:
        if breaks and blocks[-1]:
            blocks.append([])
        if slot >= 0:
            content = wrapper.content(places[slot], text)
        if content or slot < 0:
            blocks[-1].append(text if content else " ")
    lines = (" ".join("".join(parts).split()) for parts in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars.

    A null or empty page gives an empty text; a null url has the empty host. Nothing is cut or capped.
    Repeated rows each keep their row. An empty table gives an empty one.
    """
    import json

    found = wrappers(pages, html, url)

    def compiled(expression, shared):
        return Wrapper([_unpack(x) for x in json.loads(expression)], frozenset(json.loads(shared)[0]), tuple(json.loads(shared)[1])) if expression else None

    def run(batches):
        known: dict[tuple, Wrapper] = {}
        for batch in batches:
            texts = []
            for page, *wrapper in zip(batch.column(2), *(batch.column(i).to_pylist() for i in (3, 4))):
                key = tuple(wrapper)
                if key not in known:
                    if len(known) >= HOSTS:
                        known.clear()
                    known[key] = compiled(*wrapper)
                texts.append(main_text(page.as_py() or "", known[key]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    # written() cut the wrappers' lineage, so that their true size decides how they are joined
    known = found.select(F.col("host").alias("w_host"), F.col("expression").alias("w_expression"), F.col("shared").alias("w_shared"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), _host(url).alias("host"))
    both = rows.join(known, F.col("host") == F.col("w_host"), "left")
    return bounded_batches(both.select("page_id", "url", "html", "w_expression", "w_shared")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
