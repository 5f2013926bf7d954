"""HTML extraction: a recurrent labeller of blocks.

A page becomes the sequence of its leaf blocks (text between block-level tags). A block's vector holds its hashed path of tags, classes and ids, its own
tag, its hashed words and numbers about its text and its place in the tree (which container holds most of the page's text, how a block stands to it and
to its neighbours). A bidirectional LSTM in numpy reads the sequence from both ends and labels every block content or not, so a block's context in the
whole document counts. The text is that of the content blocks, in order.

The model is fitted on two kinds of pages. ``composed`` ones are put together at random from words of the pages at hand: an article and menus, notices,
adverts, forms, reader comments and so on before, within and after it, in containers with telling, foreign or no names; their labels are known by
construction. Pages of the sample whose containers' names tell what they hold join them as they are; pages without such names lend their words only.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.shared import ship

#: Pages that the labeller is fitted on (drawn by a seeded hash of their ids), composed pages, and the longest run of a page's blocks (from a seeded
#: place in it) and of its words that are used there.
TRAIN_PAGES, COMPOSED, TRAIN_BLOCKS, TRAIN_WORDS = 320, 1200, 400, 150
PATH, OWN, WORDS, NUMBERS = 64, 24, 24, 20
WIDTH = PATH + OWN + WORDS + NUMBERS
HIDDEN = 24
SEED = 5

#: A leaf block: path (outermost first; a tag and its names joined by dots), text, share of linked characters, and the path's elements by number.
Block = tuple[tuple[str, ...], str, float, tuple[int, ...]]

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""", re.S
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDES = re.compile(r"hidden|display", re.I)
UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
# Elements of HTML by kind, and what names of containers say.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset("script style title noscript template textarea iframe object svg math canvas select xmp noembed noframes".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td th tr caption summary legend".split())
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTENT = frozenset("article main content post entry story".split())
OTHER = frozenset(
    "nav header footer aside form menu button label fieldset dialog ad ads advert advertisement sponsor banner cookie cookies consent notice alert sidebar widget share social related promo comment comments reply replies newsletter subscribe breadcrumb breadcrumbs popup modal login signup search toolbar pagination copyright".split()
)


def unseen(attributes: str) -> bool:
    """Whether an element's attributes hide it from readers."""
    if not HIDES.search(attributes):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").strip()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
            return True
    return False


def leaves(page: str | None) -> list[Block]:
    """The blocks that hold text which a reader is shown: none of scripts, styles and the like, nor of hidden elements."""
    if not page:
        return []
    stack: list[tuple[str, str, int, bool]] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = total = at = opened = 0

    def close() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                nodes = [n for n in stack if n[0] not in INLINE]
                out.append((tuple(n[1] for n in nodes), text, linked / max(total, 1), tuple(n[2] for n in nodes)))
            parts.clear()
        linked = total = 0

    def say(raw: str) -> None:
        nonlocal linked, total
        if stack and stack[-1][3]:
            return
        parts.append(raw)
        total += len(raw)
        if any(n[0] == "a" for n in stack):
            linked += len(raw)

    def pop(names, barriers) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in barriers:
                return

    end = len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            parts.append("\n")
            continue
        if tag not in INLINE:
            close()
        if m[1]:
            pop({tag}, () if tag not in INLINE else CLOSE_P)
            continue
        if tag in HIDDEN_TEXT:
            if not m[0].endswith("/>") or tag not in ("svg", "math"):
                ending = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = ending.end() if ending else end
            continue
        if tag in CLOSE_P:
            pop({"p"}, CLOSE_P - {"p"})
        if tag in CLOSES:
            pop(*CLOSES[tag])
        if tag not in VOID:
            names = ".".join(w for g in NAMES.finditer(m[3]) for w in re.split(r"[^a-z0-9]+", (g[1] or g[2] or g[3] or "").lower()) if w) if m[3] else ""
            opened += 1
            stack.append((tag, f"{tag}.{names}" if names else tag, opened, bool(stack and stack[-1][3]) or bool(m[3]) and unseen(m[3])))
    close()
    return out


def weak_label(path: tuple[str, ...]) -> int:
    """1 within a container of content and none of another kind, 0 else."""
    names = {w for node in path for w in node.split(".")}
    return int(bool(names & CONTENT) and not names & OTHER)


@lru_cache(200_000)
def slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


@lru_cache(20_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH + OWN, np.float32)
    for node in path:
        for w in node.split("."):
            out[slot(w, PATH)] = 1
    for w in (path[-1] if path else "").split("."):
        out[PATH + slot(w, OWN)] = 1
    return out


def common(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Elements that two paths share."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def places(blocks: list[Block]) -> np.ndarray:
    """Where blocks stand in the tree, about the container that holds most text (a grandchild's counts half, and so on)."""
    mass: dict[int, float] = {}
    held: dict[int, list[float]] = {}
    alike: dict[tuple[str, ...], int] = {}
    deep: list[int] = []
    whole = 0.0
    for path, text, linked, ids in blocks:
        n = len(text) * (1 - linked)
        up = len(ids) - (1 if path and path[-1].split(".", 1)[0] in TEXTUAL else 0)
        deep.append(up)
        whole += n
        alike[path] = alike.get(path, 0) + 1
        for k in range(up - 1, max(-1, up - 4), -1):
            mass[ids[k]] = mass.get(ids[k], 0.0) + n
            n /= 2
        if up:
            sums = held.setdefault(ids[up - 1], [0.0, 0.0])
            sums[0] += len(text)
            sums[1] += len(text) * linked
    top = max(mass, key=lambda u: (mass[u], -u)) if mass else 0
    inside = [k for k, b in enumerate(blocks) if top in b[3]]
    first, last = (inside[0], inside[-1]) if inside else (0, len(blocks))
    chain = blocks[inside[0]][3] if inside else ()
    chain = chain[: chain.index(top) + 1] if inside else ()
    out = np.zeros((len(blocks), 12), np.float32)
    before: tuple[int, ...] = ()
    for k, ((path, _, _, ids), up) in enumerate(zip(blocks, deep, strict=True)):
        shared = common(ids, chain)
        box = ids[up - 1] if up else 0
        size, links = held.get(box, (0.0, 0.0))
        is_in = shared == len(chain)
        out[k] = (
            mass.get(box, 0.0) / max(whole, 1),
            box == top,
            is_in,
            shared / max(len(chain), 1),
            (up - len(chain)) / 4 if is_in else 0,
            k < first,
            k > last,
            np.log1p(alike[path]) / 4,
            common(ids, before) / max(len(ids), 1),
            box in before,
            links / max(size, 1),
            np.log1p(size) / 8,
        )
        before = ids
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return out
    out[:, -12:] = places(blocks)
    for k, (path, text, linked, _) in enumerate(blocks):
        row = out[k]
        row[: PATH + OWN] = path_vector(path)
        words = text.lower().split()
        at = np.fromiter((slot(w, WORDS) for w in words), np.int64, len(words))
        row[PATH + OWN : PATH + OWN + WORDS] = np.bincount(at, minlength=WORDS) / np.sqrt(len(words))
        n = len(text)
        row[-20:-12] = np.log1p(n) / 6, np.log1p(len(words)) / 4, linked, k / len(blocks), text[-1] in ".!?", sum(map(str.isdigit, text)) / n, len(path) / 8, 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init(seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"{d}x"] = r.normal(0, WIDTH**-0.5, (WIDTH, 4 * HIDDEN))
        p[f"{d}h"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        p[f"{d}b"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
    p["o"] = r.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN)
    p["ob"] = np.zeros(1)
    return p


def read(x: np.ndarray, wh: np.ndarray, steps: list[np.ndarray], step: int, keep: list | None = None) -> np.ndarray:
    """States of an LSTM that reads many sequences at once. ``x``: the inputs' part of the gates; ``steps``: the rows of the t-th blocks, of documents
    sorted by falling length; ``step``: where a row's predecessor is (-1: before it, 1: after it)."""
    out = np.zeros((len(x), HIDDEN), x.dtype)
    cells = np.zeros_like(out)
    started = np.zeros(len(x), bool)
    for at in steps if step < 0 else reversed(steps):
        before = np.clip(at + step, 0, len(x) - 1)
        known = started[before]
        h, c = out[before] * known[:, None], cells[before] * known[:, None]
        g = x[at] + h @ wh
        i, f, o = sigmoid(g[:, :HIDDEN]), sigmoid(g[:, HIDDEN : 2 * HIDDEN]), sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN])
        z = np.tanh(g[:, 3 * HIDDEN :])
        cells[at] = f * c + i * z
        out[at] = o * np.tanh(cells[at])
        started[at] = True
        if keep is not None:
            keep.append((at, before, known, i, f, o, z, h, c))
    return out


def label(blocks_of: list[np.ndarray], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """P(content) of each block of each page."""
    counts = np.array([len(x) for x in blocks_of])
    if not counts.sum():
        return [np.empty(0)] * len(counts)
    x, steps, spread = layout(blocks_of, counts)
    f = read(x @ p["fx"] + p["fb"], p["fh"], steps, -1)
    b = read(x @ p["bx"] + p["bb"], p["bh"], steps, 1)
    y = sigmoid(f @ p["o"][:HIDDEN] + b @ p["o"][HIDDEN:] + p["ob"])
    return [y[s + 1 : s + 1 + n] for s, n in zip(spread, counts, strict=True)]


def layout(blocks_of: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Rows of all pages with an empty row before and after each page (which no step visits), the steps, and where each page's empty row is."""
    spread = np.concatenate(([0], np.cumsum(counts + 1)[:-1]))
    x = np.zeros((int((counts + 1).sum()) + 1, WIDTH), np.float64)
    for s, rows in zip(spread, blocks_of, strict=True):
        x[s + 1 : s + 1 + len(rows)] = rows
    order = np.argsort(-counts, kind="stable")
    starts, falling = spread[order] + 1, counts[order]
    steps = [starts[: np.searchsorted(-falling, -t, side="left")] + t for t in range(int(falling[0]))]
    return x, steps, spread


def gradient(x, steps, target, mask, p) -> tuple[float, dict[str, np.ndarray]]:
    """Cross-entropy and its gradient by backpropagation through time."""
    kept = {"f": [], "b": []}
    states = {d: read(x @ p[f"{d}x"] + p[f"{d}b"], p[f"{d}h"], steps, -1 if d == "f" else 1, kept[d]) for d in "fb"}
    y = sigmoid(states["f"] @ p["o"][:HIDDEN] + states["b"] @ p["o"][HIDDEN:] + p["ob"])
    n = mask.sum()
    error = (y - target) * mask / n
    loss = -float((mask * (target * np.log(y + 1e-12) + (1 - target) * np.log(1 - y + 1e-12))).sum() / n)
    g = {"o": np.concatenate((error @ states["f"], error @ states["b"])), "ob": np.array([error.sum()])}
    for d in "fb":
        wh = p[f"{d}h"]
        dh = np.outer(error, p["o"][:HIDDEN] if d == "f" else p["o"][HIDDEN:])
        dc = np.zeros_like(dh)
        gates, gh = np.zeros((len(x), 4 * HIDDEN)), np.zeros_like(wh)
        for at, before, known, i, f, o, z, h, c in reversed(kept[d]):
            t = np.tanh(f * c + i * z)
            dcell = dc[at] + dh[at] * o * (1 - t**2)
            dg = np.concatenate((dcell * z * i * (1 - i), dcell * c * f * (1 - f), dh[at] * t * o * (1 - o), dcell * i * (1 - z**2)), axis=1)
            gates[at] = dg
            gh += h.T @ dg
            dh[before] += (dg @ wh.T) * known[:, None]
            dc[before] += dcell * f * known[:, None]
        g[f"{d}x"], g[f"{d}h"], g[f"{d}b"] = x.T @ gates, gh, gates.sum(axis=0)
    return loss, g


# Names that containers of each kind often have; the generator takes one of them, a foreign one or none.
TELLING = {
    "content": "article main div.content div.post section.entry div.story main.content div.article",
    "nav": "nav div.nav ul.menu div.menu div.breadcrumb ol.pagination div.toolbar",
    "header": "header div.header div.masthead",
    "footer": "footer div.footer div.copyright p.legal",
    "side": "aside aside.sidebar div.sidebar div.related div.widget",
    "notice": "div.notice div.cookie div.banner section.consent div.alert",
    "ad": "div.ad div.ads aside.promo div.sponsor ins.advert",
    "form": "form form.search form.newsletter div.subscribe form.login",
    "comments": "section.comments div.comments ol.comment-list div.replies div.discussion div.thread",
    "share": "div.share ul.social div.buttons",
}


class Composer:
    """Pages put together at random from given words, as blocks with their labels."""

    def __init__(self, words: list[str], r: np.random.Generator):
        self.words, self.r = words * (1 + 2000 // len(words)), r

    def some(self, low: int, high: int) -> int:
        return int(self.r.integers(low, high + 1))

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def of(self, *values):
        return values[self.some(0, len(values) - 1)]

    def said(self, n: int, stop: bool = True) -> str:
        n = min(n, len(self.words))
        at = self.some(0, len(self.words) - n)
        text = " ".join(self.words[at : at + n])
        if stop and self.chance(0.5):
            text = re.sub(r"((?:\S+ ){9}\S+) ", r"\1. ", text)
        return text.rstrip(".,;:") + (self.of(".", ".", ".", "!", "?") if stop else "")

    def sized(self) -> int:
        return max(1, int(np.exp(self.r.normal(3.4, 0.9))))

    def foreign(self) -> str:
        return "".join(chr(97 + int(k)) for k in self.r.integers(0, 26, self.some(2, 6)))

    def box(self, kind: str, within: list) -> list:
        p = self.r.random()
        name = self.of(*TELLING[kind].split()) if p < 0.4 else self.of("div", "div", "section", "ul" if kind == "nav" else "div") if p < 0.65 else f"{self.of('div', 'div', 'section')}.{self.foreign()}"
        return self.within(within, name)

    def within(self, stack: list, *names: str) -> list:
        out = list(stack)
        for name in names:
            self.count += 1
            out.append((name, self.count))
        return out

    def put(self, stack: list, text: str, linked: float, label: int) -> None:
        if text:
            self.blocks.append((tuple(n for n, _ in stack), text, linked, tuple(k for _, k in stack)))
            self.labels.append(label)

    def nav(self, stack):
        inner = self.box("nav", stack)
        inner = self.within(inner, "ul") if self.chance(0.7) else inner
        for _ in range(self.some(2, 9)):
            self.put(self.within(inner, self.of("li", "li", "div")), self.said(self.some(1, 3), False), 1.0, 0)

    def header(self, stack):
        inner = self.box("header", stack)
        self.put(self.within(inner, self.of("h1", "div", "p", "h2")), self.said(self.some(1, 4), False), float(self.chance(0.5)), 0)
        if self.chance(0.4):
            self.put(self.within(inner, "p"), self.said(self.some(3, 9), self.chance(0.5)), 0.0, 0)

    def footer(self, stack):
        inner = self.box("footer", stack)
        for _ in range(self.some(1, 3)):
            at = inner if self.chance(0.5) else self.within(inner, self.of("p", "div", "li"))
            self.put(at, self.of("\u00a9 ", "\u00a9 2024 ", "") + self.said(self.some(2, 25)), self.of(0.0, 0.0, 0.3, 1.0), 0)

    def side(self, stack):
        inner = self.box("side", stack)
        self.put(self.within(inner, self.of("h3", "h4", "p")), self.said(self.some(1, 4), False), 0.0, 0)
        for _ in range(self.some(1, 6)):
            self.put(self.within(inner, *self.of(("ul", "li"), ("p",), ("div",))), self.said(self.some(2, 12), self.chance(0.3)), self.of(1.0, 1.0, 0.0), 0)

    def notice(self, stack):
        inner = self.box("notice", stack)
        self.put(inner if self.chance(0.5) else self.within(inner, "p"), self.said(self.some(4, 25)), self.of(0.0, 0.2), 0)

    def ad(self, stack):
        inner = self.box("ad", stack)
        for _ in range(self.some(1, 2)):
            self.put(inner if self.chance(0.6) else self.within(inner, self.of("p", "span", "div")), self.said(self.some(2, 25), self.chance(0.8)), self.of(0.0, 0.0, 1.0, 0.5), 0)

    def form(self, stack):
        inner = self.box("form", stack)
        for _ in range(self.some(1, 4)):
            self.put(self.within(inner, self.of("label", "p", "button", "div")), self.said(self.some(1, 6), False), 0.0, 0)

    def share(self, stack):
        inner = self.box("share", stack)
        for _ in range(self.some(2, 5)):
            self.put(self.within(inner, self.of("li", "span", "div")), self.said(1, False), 1.0, 0)

    def comments(self, stack):
        inner = self.box("comments", stack)
        if self.chance(0.6):
            self.put(self.within(inner, self.of("h2", "h3", "p")), f"{self.some(1, 90)} {self.said(1, False)}" if self.chance(0.5) else self.said(self.some(1, 3), False), 0.0, 0)
        item, author, body = self.of("div", "li", "div.c", "article", f"div.{self.foreign()}"), self.of("div", "p", "span", "b", "h4"), self.of("p", "p", "div", "")
        named, dated, reply, bare = self.chance(0.8), self.chance(0.4), self.chance(0.4), self.chance(0.3)
        for _ in range(self.some(1, 8)):
            at = inner if bare else self.within(inner, item)
            if named:
                self.put(self.within(at, author), self.said(self.some(1, 2), False) + (f", {self.some(1, 28)}.{self.some(1, 12)}.20{self.some(10, 24)}" if dated else self.of("", "", ":")), self.of(0.0, 1.0), 0)
            for _ in range(self.of(1, 1, 1, 2)):
                self.put(self.within(at, body) if body else at, self.said(self.some(3, 45)), 0.0, 0)
            if reply:
                self.put(self.within(at, self.of("div", "span", "p")), self.said(1, False), 1.0, 0)

    def article(self, stack):
        inner = stack if self.chance(0.08) else self.box("content", stack)
        for _ in range(self.of(0, 0, 0, 1, 1, 2)):
            inner = self.within(inner, self.of("div", f"div.{self.foreign()}"))
        if self.chance(0.8):
            self.put(self.within(inner, self.of("h1", "h1", "h1", "h2", "h3")), self.said(self.some(1, 14), self.chance(0.2)), self.of(0.0, 0.0, 0.0, 1.0), 1)
        if self.chance(0.1):
            return self.put(inner, self.said(self.sized() * self.some(1, 20)), 0.0, 1)
        own, short = self.of("p", "p", "p", "p", "p", "div"), self.chance(0.15)
        foreign = [f for f in ("ad", "notice", "side", "share", "form", "nav") if self.chance(0.1)]
        count = self.of(1, 2, self.some(1, 6), self.some(3, 14), self.some(5, 30))
        at = inner
        for k in range(count):
            p = self.r.random()
            if p < 0.07:
                at = self.within(inner, "section") if self.chance(0.4) else inner
                self.put(self.within(at, self.of("h2", "h3", "h4")), self.said(self.some(1, 8), False), 0.0, 1)
            elif p < 0.16:
                ul = self.within(at, self.of("ul", "ol"))
                for _ in range(self.some(2, 7)):
                    self.put(self.within(ul, "li"), self.said(self.some(1, 25), self.chance(0.6)), self.of(0.0, 0.0, 0.3), 1)
            elif p < 0.21:
                self.put(self.within(at, *self.of(("blockquote", "p"), ("blockquote",), ("figure", "figcaption"), ("pre",), ("dl", "dd"))), self.said(self.sized()), 0.0, 1)
            elif p < 0.235:
                table = self.within(at, "table")
                for _ in range(self.some(1, 4)):
                    row = self.within(table, "tr")
                    for _ in range(self.some(1, 4)):
                        self.put(self.within(row, self.of("td", "td", "th")), self.of(self.said(self.some(1, 5), False), str(self.some(0, 9999))), 0.0, 1)
            else:
                n = self.some(1, 8) if short or self.chance(0.08) else self.sized()
                self.put(self.within(at, own), self.said(n, self.chance(0.95)), self.of(0.0, 0.0, 0.0, 0.0, 0.1, 0.4), 1)
            if foreign and self.chance(0.3):
                getattr(self, foreign.pop())(at)
        for kind in [*foreign, *(["share"] if self.chance(0.1) else []), *(["side"] if self.chance(0.08) else []), *(["comments"] if self.chance(0.25) else [])]:
            getattr(self, kind)(inner)

    def page(self) -> tuple[list[Block], list[int]]:
        self.blocks, self.labels, self.count = [], [], 0
        stack = self.within([], "html", "body")
        for _ in range(self.of(0, 0, 1, 1, 2)):
            stack = self.within(stack, self.of("div", f"div.{self.foreign()}"))
        bare = self.chance(0.08)
        before = [k for k, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.7), ("notice", 0.1), ("ad", 0.4), ("side", 0.15), ("form", 0.15)) if not bare and self.chance(p)]
        after = [k for k, p in (("share", 0.15), ("side", 0.3), ("comments", 0.35), ("ad", 0.2), ("form", 0.2), ("nav", 0.15), ("notice", 0.1), ("footer", 0.7)) if not bare and self.chance(p)]
        column = self.within(stack, self.of("div", "main", f"div.{self.foreign()}")) if self.chance(0.3) else stack
        for kind in before:
            getattr(self, kind)(stack)
        if not self.chance(0.03):
            self.article(column)
        for kind in after:
            getattr(self, kind)(column if self.chance(0.5) else stack)
        return self.blocks, self.labels


def composed(words: list[str], count: int, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of composed pages."""
    maker = Composer(words or ["word"], np.random.default_rng(seed))
    pages = (maker.page() for _ in range(count))
    return [(vectors(blocks), np.array(labels, float)) for blocks, labels in pages if blocks]


def fit(pages: list[tuple[np.ndarray, np.ndarray]], words: list[str], rounds: int = 320, batch: int = 32, seed: int = SEED) -> dict[str, np.ndarray]:
    """Adam over composed pages and the labelled ones given (vectors, labels), the latter a third of each step at most."""
    r = np.random.default_rng(seed)
    made = composed(words, COMPOSED, seed)
    p = init(seed)
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for t in range(1, rounds + 1):
        given = batch // 3 if pages else 0
        chosen = [pages[int(k)] for k in r.integers(0, len(pages), given)] if given else []
        chosen += [made[int(k)] for k in r.integers(0, len(made), batch - given)]
        x, steps, spread = layout([b for b, _ in chosen], np.array([len(b) for b, _ in chosen]))
        target, mask = np.zeros(len(x)), np.zeros(len(x))
        for s, (_, y) in zip(spread, chosen, strict=True):
            target[s + 1 : s + 1 + len(y)] = y
            mask[s + 1 : s + 1 + len(y)] = 1
        _, g = gradient(x, steps, target, mask, p)
        rate = 0.02 * min(1.0, 2 * (1 - t / (rounds + 1)))
        for k in p:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return p


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, np.ndarray]:
    """Fits on a bounded sample. Tasks turn its pages into vectors (of whole blocks); the driver gets, of each page, a run of at most ``TRAIN_BLOCKS``
    vectors if its names tell labels, and ``TRAIN_WORDS`` words (64 characters of a word at most), both from a seeded place in the page. Only ids are ranked, pages are fetched after."""
    ship(pages.sparkSession)
    ids = pages.select(F.col(id_col).cast("string").alias("id")).filter(F.col(html_col).isNotNull())
    chosen = ids.distinct().orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(TRAIN_PAGES)
    sample = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).filter("html is not null").join(F.broadcast(chosen), "id")  # TRAIN_PAGES ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, page in zip(b["id"], b["html"], strict=True):
                found, r = leaves(page), np.random.default_rng(zlib.crc32(key.encode()))
                labels = [weak_label(block[0]) for block in found]
                at = int(r.integers(0, max(1, len(found) - TRAIN_BLOCKS + 1)))
                run_ = slice(at, at + TRAIN_BLOCKS) if 0 < sum(labels) else slice(0, 0)
                words = " ".join(block[1] for block in found).split()
                at = int(r.integers(0, max(1, len(words) - TRAIN_WORDS + 1)))
                out.append((key, vectors(found)[run_].astype(np.float16).tobytes(), bytes(labels[run_]), [w[:64] for w in words[at : at + TRAIN_WORDS]]))
            yield pd.DataFrame(out, columns=["id", "x", "y", "words"])

    rows = sample.mapInPandas(run, "id string, x binary, y binary, words array<string>").dropDuplicates(["id"]).orderBy("id").collect()
    known = [(np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH).astype(np.float32), np.frombuffer(r["y"], np.uint8).astype(float)) for r in rows if r["y"]]
    return fit(known, [w for r in rows for w in r["words"]])


def extract(pages: DataFrame, model: dict[str, np.ndarray], html_col: str = "html", least: float = 0.5) -> DataFrame:
    """``pages`` with text and n_chars (code points), which replace columns of these names.

    Null and empty pages and those without a content block have an empty text. White space within a block is one blank; blocks are joined by two line
    ends; nothing is cut. Repeated rows are read each; an empty table gives an empty result.
    """
    ship(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text_of(pages_html: pd.Series) -> pd.Series:
        p, out = sent.value, []
        values = pages_html.tolist()
        for at in range(0, len(values), 500):
            found = [leaves(x) for x in values[at : at + 500]]
            for blocks, y in zip(found, label([vectors(b) for b in found], p), strict=True):
                out.append("\n\n".join(b[1] for b, keep in zip(blocks, y >= least, strict=True) if keep))
        return pd.Series(out, dtype=object)

    return pages.withColumn("text", text_of(F.col(html_col).cast("string"))).withColumn("n_chars", F.char_length("text").cast("bigint"))
