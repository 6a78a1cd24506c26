"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: text between the borders of block elements, with
the path of tags, classes and ids above it. Hashed path and word vectors and a few numbers
describe a block; a bidirectional LSTM in numpy reads the whole sequence both ways and labels
every block as article or not. The article's blocks, in page order, are the text.

The network is trained on the driver on ``PAGES`` generated pages of many layouts, whose
blocks are labelled by construction; it is the same for the same code. Weights go to the
tasks, and each page is read alone: nothing is shuffled. Pages of a batch run together,
sorted by their number of blocks; a longer sequence only takes more steps. Time and memory
grow in proportion to a page's length, whatever its markup.

What scripts and other raw text elements hold is no markup: they end at their own end tag, or
with the page. Other skipped elements nest and end at their matching end tag; one that has none
hides what follows up to the next border of a block that is no option, and nothing beyond.

Defined results: null or empty html, and pages without article blocks, give an empty text.
Repeated rows give repeated results; page_id and url pass as they are, nulls too. Other
columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import text_slices

#: Elements that begin and end a block, that have no end tag, and whose content is no text.
BLOCK = frozenset(
    "html head body title p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre hr form fieldset legend "
    "section article aside header footer nav main figure figcaption address details summary option select button label dialog center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea".split())
SKIPPED = RAW | frozenset("template svg select object canvas".split())
#: Elements that the start of a block ends, where they are open.
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = ("ul", "ol", "dl", "table")

#: A quote opens a value only right after an equals sign, and only where another one ends it.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.IGNORECASE)

PATHS, WORDS, VECTOR, NUMBERS, HIDDEN = 1024, 2048, 12, 8, 16
PAGES, EPOCHS = 700, 5
#: Blocks, padding included, that are labelled together, unless one page has more; blocks that are described at once.
CELLS, PART = 40_000, 5_000


class Path:
    """Tags and names above a block, each once: those that an element adds to the path ``above`` it. Blocks share the paths above them."""

    __slots__ = ("above", "added", "size", "table", "total")

    def __init__(self, above: Path | None, added: tuple[str, ...]):
        self.above, self.added, self.size, self.table, self.total = above, added, len(added) + (above.size if above else 0), None, None

    def vector(self, table: np.ndarray) -> np.ndarray:
        """The sum of the entries' rows of ``table``, from the sum of the path above; kept for as long as ``table`` is the same."""
        chain, at = [], self
        while at is not None and at.table is not table:
            chain.append(at)
            at = at.above
        total = at.total if at is not None else np.zeros(table.shape[1])
        for node in reversed(chain):
            for x in node.added:
                total = total + table[_hash(x, PATHS)]
            node.table, node.total = table, total
        return total

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[str]:
        chain, at = [], self
        while at is not None:
            chain.append(at.added)
            at = at.above
        return (x for added in reversed(chain) for x in added)

    def __eq__(self, other: object) -> bool:
        return tuple(self) == tuple(other)

    def __hash__(self) -> int:
        return hash(tuple(self))


class Block(NamedTuple):
    """``path``: each tag and name above the block once; ``leaf``: the last of them."""

    path: Path
    leaf: str
    text: str
    link_chars: int


class Token(NamedTuple):
    """A tag or comment, with the raw text that follows a tag of ``RAW``. Comments have no name."""

    start: int
    end: int
    closing: bool
    name: str
    rest: str


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the raw text from ``at`` ends: at its end tag, or with the page. A script's comment may hold scripts of its own."""
    if name != "script":
        return m.start() if (m := _RAW_ENDS[name].search(page, at)) else len(page)
    comment = inner = False
    while m := _SCRIPT.search(page, at):
        at = m.end()
        if m[0] == "<!--":
            comment, at = True, at if comment else m.start() + 2  # "<!-->" is a comment already
        elif m[0] == "-->":
            comment = inner = False
        elif not m[1]:
            inner = comment
        elif not inner:
            return m.start()
        else:
            inner = False
    return len(page)


def _tokens(page: str) -> tuple[list[Token], dict[int, int]]:
    """The page's tokens in order, and for each skipped element that nests and is closed the places of its tags among them."""
    out: list[Token] = []
    pairs: dict[int, int] = {}
    open_: dict[str, list[int]] = {name: [] for name in SKIPPED - RAW}
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        closing, name, rest = bool(m[1]), (m[2] or "").lower(), m[3] or ""
        if name in SKIPPED:
            empty = rest.rstrip().endswith("/")
            if name in RAW:
                if not closing and not (empty and open_["svg"]):
                    at = _raw_end(page, name, at)
            elif closing:
                if open_[name]:
                    pairs[open_[name].pop()] = len(out)
            elif not (empty and name == "svg"):
                if name == "select":  # selects do not nest
                    open_[name].clear()
                open_[name].append(len(out))
        out.append(Token(m.start(), at, closing, name, rest))
    return out, pairs


class _Stack:
    """Open elements, the places of each tag among them, and how often each tag or name of the path is there: no step looks at the whole path."""

    def __init__(self):
        self.open: list[tuple[str, tuple[str, ...], Path]] = []
        self.places: dict[str, list[int]] = {}
        self.entries: Counter[str] = Counter()
        self.path = Path(None, ())

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, names, self.path))
        added = []
        for x in (tag, *names):
            if not self.entries[x]:
                added.append(x)
            self.entries[x] += 1
        if added:
            self.path = Path(self.path, tuple(added))

    def pop(self) -> str:
        tag, names, self.path = self.open.pop()
        self.places[tag].pop()
        for x in (tag, *names):
            self.entries[x] -= 1
        return tag

    def last(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags, -1 if there is none."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def leaf(self) -> str:
        return (self.open[-1][1] or self.open[-1][:1])[-1] if self.open else ""


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; white space in a block is one space."""
    out: list[Block] = []
    stack = _Stack()
    held: list[str] = []
    links = 0
    at, k, unclosed = 0, 0, False  # unclosed: in a skipped element without an end

    def flush() -> None:
        nonlocal held, links
        if held and (text := " ".join("".join(held).split())):
            out.append(Block(stack.path, stack.leaf(), text, links))
        held, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if stack.places.get("a"):
                links += len(text)

    tokens, pairs = _tokens(page)
    while k < len(tokens):
        start, end, closing, name, rest = tokens[k]
        if not unclosed:
            add(page[at:start])
        at, k = end, k + 1
        if not name:
            continue
        if name in BLOCK or name in SKIPPED:
            flush()
        if unclosed and name in BLOCK:
            if name == "option":
                continue
            unclosed = False
        if name == "br":
            held.append(" ")
        if name in SKIPPED and not closing:
            if (last := pairs.get(k - 1)) is not None:
                at, k = tokens[last].end, last + 1
            elif name not in RAW and not (rest.rstrip().endswith("/") and name == "svg"):
                unclosed = True
        elif closing:
            if stack.places.get(name):
                while stack.pop() != name:
                    pass
        elif name not in VOID and name not in SKIPPED:
            if name in BLOCK:
                ends = _CLOSED_BY.get(name, ()) or ("p",)
                open_ = stack.last(ends)
                if open_ >= 0 and (ends == ("p",) or stack.last(_LISTS) < open_):
                    while len(stack.open) > open_:
                        stack.pop()
            stack.push(name, tuple(f".{x}" for g in _NAMES.findall(rest) for x in _SPLIT.split("".join(g).lower()) if x) if "=" in rest else ())
    if not unclosed:
        add(page[at:])
    flush()
    return out


_bucket: dict[str, int] = {}


def _hash(word: str, size: int) -> int:
    key = f"{size}{word}"
    if (found := _bucket.get(key)) is None:
        if len(_bucket) > 300_000:
            _bucket.clear()
        found = _bucket[key] = crc32(word.encode()) % size
    return found


class Inputs(NamedTuple):
    """Blocks of some pages: bags of path and word buckets, and numbers."""

    paths: np.ndarray
    path_ends: np.ndarray
    words: np.ndarray
    word_ends: np.ndarray
    numbers: np.ndarray


def describe(pages: list[list[Block]], first: int = 0, last: int | None = None, bags: bool = True) -> Inputs:
    """Of the pages' blocks, or of those with places ``first`` to ``last`` in each page. Without ``bags``, paths are left out."""
    paths, path_ends, words, word_ends, numbers = [], [0], [], [0], []
    for page in pages:
        total = len(page)
        for k, b in enumerate(page[first:last], first):
            if bags:
                paths += [*(_hash(x, PATHS) for x in b.path), _hash(f"leaf {b.leaf}", PATHS)]  # of wrappers as deep as they come, each kind once
                path_ends.append(len(paths))
            split = b.text.lower().split()
            words += [_hash(w.strip(".,:;!?()\"'"), WORDS) for w in split]
            word_ends.append(len(words))
            n = len(b.text)
            numbers.append((
                np.log1p(n) / 5, np.log1p(len(split)) / 4, min(1.0, b.link_chars / n), b.text[-1] in ".!?\"”»…", k / max(1, total - 1),
                sum(b.text.count(c) for c in ".,;") / n * 10, any(c.isdigit() for c in b.text), b.text.isupper(),
            ))
    return Inputs(np.array(paths, np.int64), np.array(path_ends), np.array(words, np.int64), np.array(word_ends), np.array(numbers, float).reshape(-1, NUMBERS))


def _bag(table: np.ndarray, index: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Means of the rows of each bag; every path bag and word bag has one at least."""
    counts = np.diff(ends)
    return np.add.reduceat(table[index], ends[:-1], axis=0) / counts[:, None] if len(counts) else np.zeros((0, table.shape[1]))


_sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM over blocks. Pages are columns of a padded batch."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        width = 2 * VECTOR + NUMBERS
        self.w = {"p": rng.normal(0, 0.3, (PATHS, VECTOR)), "v": rng.normal(0, 0.1, (WORDS, VECTOR)), "o": rng.normal(0, 0.2, 2 * HIDDEN + width), "ob": np.zeros(1)}
        for d in "fb":
            self.w[f"{d}x"] = rng.normal(0, 0.2, (width, 4 * HIDDEN))
            self.w[f"{d}h"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.w[f"{d}c"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])

    def _pass(self, d: str, x: np.ndarray, live: np.ndarray):
        """One direction over x (steps, pages, width): states, and what going back needs."""
        steps, n, _ = x.shape
        pre = x @ self.w[f"{d}x"] + self.w[f"{d}c"]
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, kept = np.zeros((steps, n, HIDDEN)), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.w[f"{d}h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = live[t][:, None]
            new = (f * c + i * g) * m  # a page's padding leaves the state empty
            kept[t] = (f, i, o, g, c, h, np.tanh(new), m)
            c, h = new, o * kept[t][6] * m
            out[t] = h
        return out, kept

    def _back(self, d: str, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        steps, n, _ = x.shape
        dh, dc, dz_all = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((steps, n, 4 * HIDDEN))
        gh = np.zeros_like(self.w[f"{d}h"])
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            f, i, o, g, c, h, tc, m = kept[t]
            dh = (dh + dout[t]) * m
            dc = (dc + dh * o * (1 - tc * tc)) * m
            dz = np.concatenate([dc * c * f * (1 - f), dc * g * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            gh += h.T @ dz
            dh, dc = dz @ self.w[f"{d}h"].T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad[f"{d}h"] = gh
        grad[f"{d}x"] = x.reshape(-1, x.shape[2]).T @ flat
        grad[f"{d}c"] = flat.sum(axis=0)
        return dz_all @ self.w[f"{d}x"].T

    def _forward(self, inputs: Inputs, counts: np.ndarray):
        rows = self._rows(inputs)
        steps, pages = int(counts.max()), np.repeat(np.arange(len(counts)), counts)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        x, live = np.zeros((steps, len(counts), rows.shape[1])), np.zeros((steps, len(counts)))
        x[step, pages], live[step, pages] = rows, 1
        (hf, kf), (hb, kb) = self._pass("f", x, live), self._pass("b", x, live)
        top = np.concatenate([hf[step, pages], hb[step, pages], rows], axis=1)
        return x, step, pages, kf, kb, top, top @ self.w["o"] + self.w["ob"]

    def _rows(self, inputs: Inputs, paths: np.ndarray | None = None) -> np.ndarray:
        paths = _bag(self.w["p"], inputs.paths, inputs.path_ends) if paths is None else paths
        return np.concatenate([paths, _bag(self.w["v"], inputs.words, inputs.word_ends), inputs.numbers], axis=1)

    def _described(self, pages: list[list[Block]], first: int = 0, last: int | None = None) -> np.ndarray:
        """``_rows`` of blocks, with the paths' means from sums that blocks share."""
        table, own = self.w["p"], [b for page in pages for b in page[first:last]]
        leaves = table[[_hash(f"leaf {b.leaf}", PATHS) for b in own]]
        paths = (np.array([b.path.vector(table) for b in own]) + leaves) / np.array([[len(b.path) + 1] for b in own])
        return self._rows(describe(pages, first, last, bags=False), paths)

    def train(self, pages: list[list[Block]], labels: list[list[int]], epochs: int = EPOCHS, seed: int = 5) -> None:
        rng, count = np.random.default_rng(seed), 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // 16)):
                own = [pages[i] for i in at]
                y, counts, inputs = np.concatenate([labels[i] for i in at]), np.array([len(p) for p in own]), describe(own)
                x, step, column, kf, kb, top, z = self._forward(inputs, counts)
                dz = (_sigmoid(z) - y) / len(y)
                grad = {"o": top.T @ dz, "ob": dz.sum(keepdims=True)}
                dtop = dz[:, None] * self.w["o"]
                df, db = np.zeros((*x.shape[:2], HIDDEN)), np.zeros((*x.shape[:2], HIDDEN))
                df[step, column], db[step, column] = dtop[:, :HIDDEN], dtop[:, HIDDEN : 2 * HIDDEN]
                drows = (self._back("f", x, kf, df, grad) + self._back("b", x, kb, db, grad))[step, column] + dtop[:, 2 * HIDDEN :]
                for name, a, index, ends in (("p", 0, inputs.paths, inputs.path_ends), ("v", VECTOR, inputs.words, inputs.word_ends)):
                    grad[name] = np.zeros_like(self.w[name])
                    each = drows[:, a : a + VECTOR] / np.diff(ends)[:, None]
                    np.add.at(grad[name], index, np.repeat(each, np.diff(ends), axis=0))
                count += 1
                rate = 0.01 * (1 - epoch / (epochs + 1))
                for name, g in grad.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[name] -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.999**count)) + 1e-8)

    def _states(self, d: str, x: np.ndarray, live: np.ndarray, out: np.ndarray) -> None:
        """``_pass`` without what going back needs; states are written into ``out``."""
        n = x.shape[1]
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = x[t] @ self.w[f"{d}x"] + self.w[f"{d}c"] + h @ self.w[f"{d}h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            m = live[t][:, None]
            c = (gates[:, :HIDDEN] * c + gates[:, HIDDEN : 2 * HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])) * m
            h = out[t] = gates[:, 2 * HIDDEN :] * np.tanh(c) * m

    def _together(self, own: list[list[Block]]) -> list[np.ndarray]:
        """Probabilities of pages that run as one padded batch."""
        counts = np.array([len(p) for p in own])
        if len(own) == 1:  # a long page is described in parts
            rows = np.concatenate([self._described(own, k, k + PART) for k in range(0, len(own[0]), PART)])
        else:
            rows = self._described(own)
        pages = np.repeat(np.arange(len(counts)), counts)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        x, live = np.zeros((int(counts.max()), len(counts), rows.shape[1])), np.zeros((int(counts.max()), len(counts)))
        x[step, pages], live[step, pages] = rows, 1
        z = rows @ self.w["o"][2 * HIDDEN :] + self.w["ob"]
        states = np.zeros((*live.shape, HIDDEN))
        for d, weights in (("f", self.w["o"][:HIDDEN]), ("b", self.w["o"][HIDDEN : 2 * HIDDEN])):
            self._states(d, x, live, states)
            z += (states @ weights)[step, pages]
        return np.split(_sigmoid(z), np.cumsum(counts)[:-1])

    def label(self, pages: list[list[Block]], cells: int = CELLS) -> list[np.ndarray]:
        """For each page the blocks' probabilities of being article text. A batch has ``cells`` steps times pages at most, or one page."""
        out = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 128 and (end - at + 1) * len(pages[order[end]]) <= cells:
                end += 1
            for i, part in zip(order[at:end], self._together([pages[i] for i in order[at:end]]), strict=True):
                out[i] = part
            at = end
        return out


def generated_pages(n: int = PAGES, seed: int = 1) -> tuple[list[list[Block]], list[list[int]]]:
    """Pages of random layouts and their blocks' labels. Blocks are marked in the text by a last word that is taken off again."""
    r, d = random.Random(seed), random.Random(-seed - 1)
    syllables = "th er an re on in at nd st es ou ion ent che ein der ung les eau que ado ción ier au el la is to of die und et y os".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    junk = "".join

    def prose(low: int = 3, high: int = 60) -> str:
        said = " ".join(word() + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(low, high))).capitalize()
        said += r.choice([".", ".", ".", "!", "?", ""])
        if r.random() < 0.06:
            said = " ".join(w + r.choice(["###", "%%%", "&amp;&amp;&amp;", "***", "$$$"]) for w in said.split())
        if r.random() < 0.05:
            said = " ".join(w + "!!" for w in said.upper().split())
        if r.random() < 0.06:
            said = r.choice([word(), " | ".join(word() for _ in range(high)), f"{r.randint(1, 99)}.{r.randint(100, 255)} {said}", said.upper()])
        return said

    # a block of label y
    def block(tag: str, y: int, text: str, attrs: str = "") -> str:
        close = "" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>"
        inner = text
        if r.random() < 0.1:
            inner = f"<b>{text}" + ("</b>" if r.random() < 0.6 else "<br>")
        elif r.random() < 0.1:
            inner = f'{text} <a href="/x">{word()}</a>'
        return f"<{tag}{attrs}>{inner} \x01{y} {close}"

    def named(tags: str, names: str) -> tuple[str, str]:
        tag, name = r.choice(tags.split()), r.choice(names.split())
        if tag in ("nav", "footer", "header", "aside", "article", "main") and r.random() < 0.6:
            return tag, ""
        return tag, r.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"', f' class="{name}-{word()}"'])

    def wrap(tags: str, names: str, inner: str) -> str:
        tag, attrs = named(tags, names)
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def deep(inner: str) -> str:
        """Wrappers of no meaning around ``inner``, on some pages many."""
        if d.random() < 0.8:
            return inner
        kinds = [d.choice(["", "", f' class="{" ".join(d.sample("wrapper container outer inner row col grid layout".split(), d.randint(1, 3)))}"', f' class="{d.choice(syllables)}{d.choice(syllables)}"']) for _ in range(d.randint(1, 3))]
        k = d.choice([1, 2, 4, 20])
        return junk(f"<div{d.choice(kinds)}>" for _ in range(k)) + inner + "</div>" * k

    links = lambda k: "<ul>" + junk(block("li", 0, f'<a href="/{word()}">{word()}</a>') for _ in range(k)) + "</ul>"
    bare = lambda k: junk(f'<a href="/{word()}">{word()}</a> ' for _ in range(k)) + "\x010 "
    paragraphs = lambda k, y: junk(block("p", y, prose()) for _ in range(k))
    menu = lambda: wrap("nav div div header", "menu nav navbar navigation topnav breadcrumb", r.choice([links, bare])(r.randint(2, 9)))
    header = lambda: wrap("header div div", "header masthead banner top site-header logo", block("div", 0, prose(1, 6)) + (links(3) if r.random() < 0.4 else ""))
    advert = lambda: wrap("div div div aside section", "ad ads advert advertisement sponsored promo banner adbox", r.choice([lambda: prose(2, 30) + " \x010 ", lambda: block("p", 0, prose(2, 30))])())
    sidebar = lambda: wrap("aside div div section", "sidebar side related widget recommended trending more-stories", block("h3", 0, prose(1, 4)) + r.choice([lambda: links(r.randint(2, 6)), lambda: paragraphs(r.randint(1, 4), 0)])())
    notice = lambda: wrap("div div section aside dialog", "cookie cookies consent notice alert popup gdpr privacy modal overlay", block(r.choice(["p", "div", "span"]), 0, r.choice(["We use cookies", "Accept all", "Sign up", prose(2, 5)]) + " " + prose(3, 30)) + (block("button", 0, r.choice(["OK", "Accept", word()])) if r.random() < 0.5 else ""))
    form = lambda: "<form>" + block(r.choice(["label", "p", "legend"]), 0, prose(1, 12)) + "<input name=q>" + block("button", 0, r.choice(["Send", "Search", "Subscribe", word()])) + "</form>"
    comment = lambda: wrap("div li article section", "comment reply comment-body response", (block("div", 0, word() + " " + str(r.randint(1, 28))) if r.random() < 0.6 else "") + paragraphs(r.randint(1, 3), 0))
    comments = lambda: wrap("section div div ol", "comments commentlist discussion responses disqus reader-comments", (block("h2", 0, r.choice(["Comments", "Reader comments", prose(1, 4)])) if r.random() < 0.6 else "") + junk(comment() for _ in range(r.randint(1, 5))))
    footer = lambda: wrap("footer footer div div", "footer foot colophon bottom copyright site-footer", r.choice([lambda: f"&copy; {word()}.example.net &middot; {prose(2, 20)} \x010 ", lambda: block("p", 0, "&copy; " + prose(2, 20)), lambda: links(4) + paragraphs(1, 0)])())
    share = lambda: wrap("div ul", "share social sharing tools buttons", bare(r.randint(2, 5)))

    def article() -> str:
        parts = [block("h1", 1, prose(2, 12))] if r.random() < 0.85 else []
        if parts and r.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 15, 40])):
            kind = r.random()
            if kind < 0.72:
                parts.append(block("p", 1, prose(1, r.choice([3, 10, 90]))))
            elif kind < 0.79:
                parts.append(block(r.choice(["h2", "h3"]), 1, prose(1, 8)))
            elif kind < 0.84:
                parts.append("<ul>" + junk(block("li", 1, prose(2, 20)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.87:
                parts.append(block(r.choice(["blockquote", "pre"]), 1, prose(3, 30)))
            elif kind < 0.89:
                parts.append("<table><tr>" + junk(block("td", 1, prose(1, 4)) for _ in range(4)) + "</tr></table>")
            elif kind < 0.93:
                parts.append(block("div", 1, prose(5, 60)))
            else:
                parts.append(r.choice([advert, advert, share, sidebar, form, notice])())
        body = junk(parts) or block("p", 1, prose(5, 40))
        if r.random() < 0.3:
            body = f"<div>{body}</div>"
        body = deep(body)
        return wrap("article article main div div section td", "content main post story entry article article-body text post-content", body)

    pages, labels = [], []
    for _ in range(n):
        before = [f() for f in r.sample([menu, menu, header, advert, notice, form], r.randint(0, 4))]
        after = [f() for f in r.sample([sidebar, comments, comments, footer, footer, advert, share, form, notice, menu], r.randint(0, 5))]
        if r.random() < 0.3:
            before.append(sidebar())
        title = f"<title>{prose(2, 10)} \x010 </title>" if r.random() < 0.9 else ""
        main = junk(before) + (article() if r.random() < 0.97 else "") + junk(after)
        if r.random() < 0.3:
            main = f'<div{r.choice(["", " id=page", " class=wrapper", " class=container"])}>{main}</div>'
        main = deep(main)
        page = f"<html><head>{title}<script>var t='<p>';</script></head><body>{main}</body></html>"
        found = [(b, re.search("\x01(\\d)", b.text)) for b in blocks(page)]
        found = [(b._replace(text=text), int(m[1])) for b, m in found if m and (text := " ".join(re.sub("\x01\\d", " ", b.text).split()))]
        if found:
            pages.append([b for b, _ in found])
            labels.append([y for _, y in found])
    return pages, labels


@lru_cache(maxsize=1)
def trained() -> Labeller:
    labeller = Labeller()
    labeller.train(*generated_pages())
    return labeller


def _extract(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller: Labeller = sent.value
        for batch in batches:
            for rows, _, _ in text_slices(batch, "html"):
                pages = [blocks(h) if h else [] for h in rows.column("html").to_pylist()]
                texts = ["\n".join(b.text for b, p in zip(page, own, strict=True) if p >= 0.5) for page, own in zip(pages, labeller.label(pages), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(b) for b in pages], pa.int64())],
                    names=["page_id", "url", "text", "n_blocks"],
                )

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_blocks) of ``pages`` (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())  # weights: a fixed number
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract(sent), f"page_id {kind}, url string, text string, n_blocks long")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
