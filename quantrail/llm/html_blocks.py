"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks, runs of text between block-level tags. A bidirectional LSTM in numpy reads, for each block in
page order, the mean vector of its hashed tag path (tag names and class words of its ancestors), the mean vector of its
hashed words and a few numbers, and labels every block from the context of the whole document. The labeller is trained here,
on pages made by html_pages with known labels.

Defined results: a null or empty page has the empty text; unclosed tags, comments and quotes end with the page;
repeated rows get equal results; extra columns pass through; nothing is dropped or capped within a kept block but the
content of RAW elements, which don't end a block.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash sizes and vector lengths of path parts and words; units of each direction.
PATHS, WORDS, PATH_SIZE, WORD_SIZE, NUMBERS, UNITS = 2048, 1024, 16, 8, 8, 16
#: Pages scored at a time, at most, and blocks of a group with its padding; a page of more blocks is a group by itself.
GROUP, CELLS = 64, 100_000
#: Steps of a sequence whose inputs are multiplied at a time.
STRIDE = 4096

#: Fixed values of HTML: elements without text of their own, those of them that take no room on the page, elements that end a block, elements without an end tag.
RAW = "script|style|textarea|title|noscript|iframe|template|svg|object|select|canvas|audio|video"
UNSEEN = frozenset("script style title noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag ends, if it is still open in the same container.
ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table div section article aside nav main header footer form body blockquote".split())

TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:(?<=svg)[^>]*/>|[^>]*>.*?(?:</(?P=raw)\s*>|\Z))|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"'<]++|\"[^\"<]*\"|'[^'<]*')*+|[^>]*)>|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: What goes on to the page's end if no > follows.
OPEN_END = re.compile(r"<[!?/]")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PART = re.compile(r"[a-z]+")


@functools.lru_cache(maxsize=100_000)
def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


@functools.lru_cache(maxsize=20_000)
def _parts(tag: str, rest: str) -> tuple[int, ...]:
    """Hashed path parts of a tag: its name, and the words of its class, id and role."""
    found = [f"<{tag}"]
    for m in NAMES.findall(rest):
        found += PART.findall("".join(m).lower())
    return tuple(_bucket(p, PATHS) for p in dict.fromkeys(found))


class Node:
    """An open element: its parent, its own path parts, how many parts the path to it has, and the nearest block element's name."""

    __slots__ = ("block", "name", "parent", "parts", "size")

    def __init__(self, name: str, parts: tuple[int, ...], parent: Node | None):
        self.name, self.parts, self.parent = name, parts, parent
        self.size = len(parts) + (parent.size if parent else 0)
        self.block = name if name in BLOCKS else parent.block if parent else ""


@dataclass
class Block:
    text: str
    path: Node | None  # the innermost open element; paths share their beginnings, so a block costs the same at any depth
    link: int  # characters inside links
    tag: str


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page with text, in order."""
    out: list[Block] = []
    stack: list[Node] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    path: Node | None = None
    tag, link, links = "", 0, 0
    at, page = 0, page or ""

    def flush() -> None:
        nonlocal link
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, path, link, tag))
            held.clear()
        link = 0

    def text(part: str) -> None:
        nonlocal path, tag, link
        if not held:
            if not part.strip():
                return
            path = stack[-1] if stack else None
            tag = path.block if path else ""
        part = html.unescape(part) if "&" in part else part
        held.append(part)
        if links:
            link += len(part)

    # Behind the last > no tag ends, so none is looked for there.
    last = page.rfind(">") + 1
    for m in TOKEN.finditer(page, 0, last):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m["tag"]
        if name is None:
            if at == last and (m["raw"] and not (page.endswith("/>", 0, at) and m["raw"].lower() == "svg") and not re.search(rf"</{m['raw']}\s*>\Z", m[0], re.I) or page.startswith("<!--", m.start()) and not re.search(r"--!?>\Z", m[0])):
                last = at = len(page)  # it goes on to the page's end
            # A raw element stands in a line of text, so the block goes on behind it.
            if m["raw"] and held and m["raw"].lower() not in UNSEEN:
                held.append(" ")
            continue
        name = name.lower()
        if name in BLOCKS:
            flush()
        elif name == "br" and held:
            held.append(" ")
        if name in VOID:
            continue
        if m["close"]:
            if opened[name]:
                while True:
                    opened[(gone := stack.pop().name)] -= 1
                    if gone == name:
                        break
        else:
            if (ends := ENDS.get(name)) and any(opened[e] for e in ends):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in ends:
                        opened.subtract(x.name for x in stack[i:])
                        del stack[i:]
                        break
                    if stack[i].name in CONTAINERS:
                        break
            stack.append(Node(name, _parts(name, m["rest"]), stack[-1] if stack else None))
            opened[name] += 1  # a slash at the end of a tag means nothing in HTML
        if name == "a":
            links = 0 if m["close"] else 1
    if at < len(page):
        rest = page[at:]
        text(rest[: m.start()] if (m := OPEN_END.search(rest)) else rest)
    flush()
    return out


def features(blocks: list[Block]) -> tuple[list[Node | None], list[np.ndarray], np.ndarray]:
    """Path and hashed words of each block, and its numbers."""
    n = len(blocks)
    paths = [b.path for b in blocks]
    words, numbers = [], np.zeros((n, NUMBERS))
    for i, b in enumerate(blocks):
        found = b.text.lower().split()
        words.append(np.array([_bucket(w, WORDS) for w in found], np.int64))
        size = len(b.text)
        numbers[i] = (
            np.log1p(size) / 5,
            b.link / max(size, 1),
            np.log1p(len(found)) / 4,
            min(1.0, sum(map(b.text.count, ".,;:!?")) / max(len(found), 1)),
            i / n,
            b.tag[:1] == "h" and b.tag[1:].isdigit(),
            b.tag == "p",
            b.tag == "li",
        )
    return paths, words, numbers


def parts_of(path: Node | None) -> np.ndarray:
    """All parts of a path; for training, on pages of small depth."""
    out: list[int] = []
    while path is not None:
        out += path.parts
        path = path.parent
    return np.array(out, np.int64)


def path_means(paths: list[Node | None], table: np.ndarray) -> np.ndarray:
    """The mean vector of each path. Sums run along the tree of open elements, each added once."""
    order: list[Node] = []
    place: dict[int, int] = {}
    for path in paths:
        new = []
        while path is not None and id(path) not in place:
            place[id(path)] = -1
            new.append(path)
            path = path.parent
        for node in reversed(new):
            place[id(node)] = len(order)
            order.append(node)
    sums = averaged([np.array(x.parts, np.int64) for x in order], table) if order else np.zeros((0, table.shape[1]))
    for i, x in enumerate(order):
        sums[i] *= len(x.parts)
        if x.parent is not None:
            sums[i] += sums[place[id(x.parent)]]
    out = np.zeros((len(paths), table.shape[1]))
    there = [k for k, p in enumerate(paths) if p is not None and p.size]
    if there:
        out[there] = sums[[place[id(paths[k])] for k in there]] / np.array([paths[k].size for k in there])[:, None]
    return out


def averaged(tokens: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """The mean vector of each list of tokens."""
    counts = np.array([len(t) for t in tokens])
    out = np.zeros((len(tokens), table.shape[1]))
    if counts.sum():
        full = np.nonzero(counts)[0]
        sums = np.add.reduceat(table[np.concatenate(tokens)], np.concatenate([[0], np.cumsum(counts[full])[:-1]]), axis=0)
        out[full] = sums / counts[full, None]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of an LSTM over x (pages, blocks, size); keep collects what the backward pass needs."""
    pages, steps, _ = x.shape
    units = u.shape[0]
    h, c = np.zeros((pages, units)), np.zeros((pages, units))
    out = np.empty((pages, steps, units))
    for t in range(steps):
        if t % STRIDE == 0:
            part = x[:, t : t + STRIDE]
            z = (part.reshape(-1, x.shape[2]) @ w + b).reshape(pages, part.shape[1], -1)
        a = z[:, t % STRIDE] + h @ u
        gates = sigmoid(a[:, : 3 * units])
        i, f, o = gates[:, :units], gates[:, units : 2 * units], gates[:, 2 * units :]
        g = np.tanh(a[:, 3 * units :])
        before, c = c, f * c + i * g
        s = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, g, s))
        h = out[:, t] = o * s
    return out


def turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse order; padding stays behind."""
    t = np.arange(x.shape[1])[None, :]
    at = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
    return np.take_along_axis(x, at[:, :, None], axis=1)


def padded(pages: list[tuple], model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p[2]) for p in pages])
    flat = np.hstack([path_means([a for p in pages for a in p[0]], model["path"]), averaged([a for p in pages for a in p[1]], model["word"]), np.concatenate([p[2] for p in pages])])
    x = np.zeros((len(pages), lengths.max(), flat.shape[1]))
    x[np.arange(x.shape[1])[None, :] < lengths[:, None]] = flat
    return x, lengths


def main_probability(pages: list[tuple], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page's features, the probability of each block that it is main text."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if len(p[2])), key=lambda i: len(pages[i][2]))
    groups: list[list[int]] = []
    for i in order:  # from the shortest on, so a page pads none that are much shorter
        if not groups or len(groups[-1]) == GROUP or (len(groups[-1]) + 1) * len(pages[i][2]) > CELLS:
            groups.append([])
        groups[-1].append(i)
    for group in groups:
        x, lengths = padded([pages[i] for i in group], model)
        ahead = lstm(x, model["w0"], model["u0"], model["b0"])
        back = turned(lstm(turned(x, lengths), model["w1"], model["u1"], model["b1"]), lengths)
        p = sigmoid(np.concatenate([ahead, back], axis=2) @ model["out"] + model["bias"])[:, :, 0]
        for row, i in enumerate(group):
            out[i] = p[row, : lengths[row]]
    return out


def lstm_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of x, w, u and b for gradients of the states."""
    pages, steps, _ = x.shape
    units = u.shape[0]
    dz = np.empty((pages, steps, 4 * units))
    du = np.zeros_like(u)
    dh, dc = np.zeros((pages, units)), np.zeros((pages, units))
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, s = kept[t]
        dh = dh + grad[:, t]
        dc = dc + dh * o * (1 - s * s)
        a = dz[:, t]
        a[:, :units] = dc * g * i * (1 - i)
        a[:, units : 2 * units] = dc * before * f * (1 - f)
        a[:, 2 * units : 3 * units] = dh * s * o * (1 - o)
        a[:, 3 * units :] = dc * i * (1 - g * g)
        du += h.T @ a
        dh, dc = a @ u.T, dc * f
    flat = dz.reshape(-1, 4 * units)
    return (flat @ w.T).reshape(x.shape), x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def fit(pages: list[tuple], labels: list[np.ndarray], epochs: int = 3, rate: float = 0.01, batch: int = 24, seed: int = 7) -> dict[str, np.ndarray]:
    """Trains the labeller by back-propagation through time and Adam."""
    rng = np.random.default_rng(seed)
    size = PATH_SIZE + WORD_SIZE + NUMBERS
    model = {"path": rng.normal(0, 0.3, (PATHS, PATH_SIZE)), "word": rng.normal(0, 0.1, (WORDS, WORD_SIZE)), "out": rng.normal(0, 0.2, (2 * UNITS, 1)), "bias": np.zeros(1)}
    for d in "01":
        model |= {f"w{d}": rng.normal(0, size**-0.5, (size, 4 * UNITS)), f"u{d}": rng.normal(0, UNITS**-0.5, (UNITS, 4 * UNITS)), f"b{d}": np.concatenate([np.zeros(UNITS), np.ones(UNITS), np.zeros(2 * UNITS)])}
    first, second, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        order = [g for at in range(0, len(order), 8 * batch) for g in np.array_split(sorted(order[at : at + 8 * batch], key=lambda i: len(labels[i])), 8) if len(g)]
        for group in order:
            mine = [pages[i] for i in group]
            x, lengths = padded(mine, model)
            there = np.arange(x.shape[1])[None, :] < lengths[:, None]
            y = np.zeros(there.shape)
            y[there] = np.concatenate([labels[i] for i in group])
            kept0: list = []
            kept1: list = []
            xr = turned(x, lengths)
            states = np.concatenate([lstm(x, model["w0"], model["u0"], model["b0"], kept0), turned(lstm(xr, model["w1"], model["u1"], model["b1"], kept1), lengths)], axis=2)
            p = sigmoid(states @ model["out"] + model["bias"])[:, :, 0]
            error = np.where(there, p - y, 0)[:, :, None] / there.sum()
            grads = {"out": (states.reshape(-1, 2 * UNITS).T @ error.reshape(-1, 1)), "bias": error.sum((0, 1))}
            ds = error @ model["out"].T
            dx0, grads["w0"], grads["u0"], grads["b0"] = lstm_back(x, model["w0"], model["u0"], kept0, ds[:, :, :UNITS])
            dx1, grads["w1"], grads["u1"], grads["b1"] = lstm_back(xr, model["w1"], model["u1"], kept1, turned(ds[:, :, UNITS:], lengths))
            dx = (dx0 + turned(dx1, lengths))[there]
            for name, k, lo, hi in (("path", 0, 0, PATH_SIZE), ("word", 1, PATH_SIZE, PATH_SIZE + WORD_SIZE)):
                tokens = [parts_of(a) if k == 0 else a for q in mine for a in q[k]]
                counts = np.array([len(a) for a in tokens])
                grads[name] = np.zeros_like(model[name])
                np.add.at(grads[name], np.concatenate(tokens), np.repeat(dx[:, lo:hi] / np.maximum(counts, 1)[:, None], counts, axis=0))
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] = model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


@functools.lru_cache(maxsize=1)
def trained(pages: int = 2500) -> dict[str, np.ndarray]:
    """The labeller, fitted on generated pages; the same in every process."""
    from .html_pages import training_pages

    rows = [(blocks_of(page), labels) for page, labels in training_pages(pages)]
    known = [(features(b), np.array([labels.get(x.text, 0) for x in b], float)) for b, labels in rows if b]
    return fit([k[0] for k in known], [k[1] for k in known])


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def main_texts(pages: list[str | None], model: dict[str, np.ndarray]) -> list[str]:
    found = [blocks_of(p) for p in pages]
    scores = main_probability([features(b) for b in found], model)
    return ["\n".join(x.text for x, p in zip(b, s, strict=True) if p >= 0.5) for b, s in zip(found, scores, strict=True)]


def extracted(page: Column | str, model) -> Column:
    """struct<text, n_chars> of an html column; model is a broadcast variable of the labeller, whose size is fixed."""

    @F.pandas_udf(RESULT)
    def run(pages: pd.Series) -> pd.DataFrame:
        texts = main_texts(pages.tolist(), model.value)
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return run(F.col(page) if isinstance(page, str) else page)
