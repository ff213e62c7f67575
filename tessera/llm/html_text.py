"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, with
the path of open tags. Each block becomes a vector: hashed path elements (tag
names, class, id and role words), hashed words, length and share of link text.
A bidirectional LSTM (numpy) reads the page's blocks in both directions, so
every block is classified with the whole page as context; blocks above 0.5
are the main text.

The labeller is trained when the operator is set up, on at most ``SAMPLE``
pages (the smallest id hashes). Their blocks are labelled by their markup
(inside an article-like container and not inside menus, forms, comments, ...);
training varies the container's name, hides path elements at random and inserts blocks of
foreign text in unwanted containers, so that the network leans on context and
not on one tag. Training is seeded: reruns agree.

Defined results: null and empty html have empty text; a page cut off anywhere
is read as far as it goes (an open comment, script, style, textarea, title or
iframe runs to the end); svg, math, object, canvas, template and noscript are
path elements like others, empty if they close themselves;
character references are decoded once; white space inside a block becomes one
space; a table without pages gives an empty result; rows that repeat get equal
texts; input columns of the same name as an output column are replaced.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SAMPLE = 300
PATH_DIM, WORD_DIM = 96, 24
DIM = PATH_DIM + WORD_DIM + 4
HIDDEN = 16
EPOCHS, BATCH, RATE = 16, 24, 0.015

# Tags by their role in a page, and words in class, id and role attributes.
RAW = {"script", "style", "textarea", "title", "iframe"}  # text up to the end tag, never markup
VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "area", "base", "col", "embed", "source", "track"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "canvas", "object",
          # Drawings and formulas stand in a line of text.
          "svg", "circle", "clippath", "defs", "desc", "ellipse", "g", "line", "lineargradient", "mask", "path", "polygon", "polyline", "radialgradient", "rect",
          "stop", "symbol", "text", "tspan", "use", "math", "annotation", "mfrac", "mi", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "mspace",
          "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics"}
CONTENT_TAGS = {"article", "main"}
CONTENT_WORDS = {"article", "content", "post", "entry", "story", "main", "text", "body"}
OTHER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
OTHER_WORDS = {"ad", "ads", "advert", "banner", "breadcrumb", "comment", "comments", "cookie", "footer", "form", "menu", "nav", "newsletter", "notice",
               "pager", "popup", "promo", "related", "share", "sidebar", "social", "sponsor", "subscribe", "toolbar", "widget"}

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: float):
        self.path, self.text, self.linked = path, text, linked


def _names(tag: str, rest: str) -> str:
    """A path element: the tag and the words of its class, id and role."""
    if "=" not in rest:
        return tag
    words = [w for m in _ATTRIBUTE.finditer(rest) for w in _WORDS.findall((m[2] or m[3] or m[4] or "").lower())]
    return ".".join([tag, *words])


def blocks(html: str) -> list[Block]:
    """Leaf blocks of a page in order; one pass over the text."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    run: list[str] = []
    linked = total = links = 0

    def flush() -> None:
        nonlocal linked, total
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            found.append(Block(tuple(n for _, n in stack), text, linked / max(1, total)))
        run.clear()
        linked = total = 0

    def add(raw: str) -> None:
        nonlocal linked, total
        if raw:
            run.append(unescape(raw))
            total += len(raw)
            linked += len(raw) if links else 0

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        add(html[at:lt])
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            close = html.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = _TAG.match(html, lt)
        if not m:
            if lt + 1 < end and (html[lt + 1].isalpha() or html[lt + 1] == "/") and html.find(">", lt) < 0:
                break  # a tag that the page's end cuts off
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[1].lower()
        if html[lt + 1] == "/":
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag not in INLINE:
                flush()
            if depth is not None:
                links -= sum(t == "a" for t, _ in stack[depth:])
                del stack[depth:]
            continue
        if tag in RAW:
            if m[2].endswith("/") and any(t in ("svg", "math") for t, _ in stack):
                continue  # only inside drawings and formulas can a raw element close itself
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end if close is None else close.end()
            continue
        if tag == "br":
            run.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            # A new paragraph or item ends an open one, and inline elements left open in it.
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or stack and stack[-1][0] == "p":
                last = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), None)
                if last is not None and (stack[last][0] == tag or stack[last][0] == "p"):
                    links -= sum(t == "a" for t, _ in stack[last:])
                    del stack[last:]
        if not m[2].endswith("/"):
            stack.append((tag, _names(tag, m[2])))
            links += tag == "a"
    flush()
    return found


def silver(block: Block) -> int | None:
    """Label by markup: 1 inside an article-like container, 0 in another part of the page."""
    inside = 0
    for name in block.path:
        tag, *words = name.split(".")
        if tag in OTHER_TAGS or OTHER_WORDS.intersection(words) or (tag == "header" and not inside):
            return 0
        if tag in CONTENT_TAGS or (tag in ("div", "section", "td") and CONTENT_WORDS.intersection(words)):
            inside = 1
    return inside


def _hash(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _PATHS:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        v = np.zeros(PATH_DIM, dtype=np.float32)
        for name in path:
            for word in name.split("."):
                v[_hash(word, PATH_DIM)] = 1
        _PATHS[path] = v
    return _PATHS[path]


def vectors(page: list[Block]) -> np.ndarray:
    """[blocks, DIM]."""
    x = np.zeros((len(page), DIM), dtype=np.float32)
    for i, b in enumerate(page):
        words = b.text.split()
        x[i, :PATH_DIM] = _path_vector(b.path)
        # Shares are capped so that a block of one repeated word stays within what training pages show.
        x[i, PATH_DIM:PATH_DIM + WORD_DIM] = np.minimum(np.bincount([_hash(w, WORD_DIM) for w in words], minlength=WORD_DIM) / (1 + len(words)), 0.15)
        x[i, -4:] = (np.log1p(len(b.text)) / 8, b.linked, len(words) < 3, 1)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Two LSTMs over a page's blocks and a logistic output on their states."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.1, (DIM, 4 * HIDDEN)).astype(np.float32)
            self.p[f"h{d}"] = r.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, dtype=np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1  # remember at first
            self.p[f"c{d}"] = bias
        self.p["o"] = r.normal(0, 0.1, (2 * HIDDEN,)).astype(np.float32)
        self.p["b"] = np.zeros(1, dtype=np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States [pages, blocks, HIDDEN] of one direction; masked steps keep the state."""
        n, steps, _ = x.shape
        given = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        c = np.zeros((n, HIDDEN), dtype=np.float32)
        out, kept = np.zeros((n, steps, HIDDEN), dtype=np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[:, t, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            kept.append((t, i, f, o, g, tc, c, h))
            c = m * c_new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[:, t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray):
        hf, kf = self._run(x, mask, "f")
        hb, kb = self._run(x, mask, "b")
        states = np.concatenate([hf, hb], axis=2)
        return _sigmoid(states @ self.p["o"] + self.p["b"]), states, kf, kb

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        p, states, kf, kb = self.forward(x, mask)
        dz = (p - y) * mask / mask.sum()
        g = {"o": np.einsum("nt,nth->h", dz, states), "b": np.array([dz.sum()])}
        ds = dz[:, :, None] * self.p["o"]
        for d, kept, dh_out in (("f", kf, ds[:, :, :HIDDEN]), ("b", kb, ds[:, :, HIDDEN:])):
            dx, dhh, dc_bias = (np.zeros_like(self.p[f"{k}{d}"]) for k in "xhc")
            dh = np.zeros((len(x), HIDDEN), dtype=np.float32)
            dc = np.zeros((len(x), HIDDEN), dtype=np.float32)
            for t, i, f, o, gg, tc, c_prev, h_prev in reversed(kept):
                m = mask[:, t, None]
                dh = dh + dh_out[:, t]
                dhn, dcn = dh * m, dc * m
                dcn = dcn + dhn * o * (1 - tc * tc)
                dzs = np.concatenate([dcn * gg * i * (1 - i), dcn * c_prev * f * (1 - f), dhn * tc * o * (1 - o), dcn * i * (1 - gg * gg)], axis=1)
                dx += x[:, t].T @ dzs
                dhh += h_prev.T @ dzs
                dc_bias += dzs.sum(0)
                dh = dh * (1 - m) + dzs @ self.p[f"h{d}"].T
                dc = dc * (1 - m) + dcn * f
            g[f"x{d}"], g[f"h{d}"], g[f"c{d}"] = dx, dhh, dc_bias
        return g

    def train(self, pages: list[tuple[list[Block], list[int]]], seed: int = 5) -> Labeller:
        """Adam on augmented pages."""
        r = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        foreign = [b.text for page, _ in pages for b in page]
        step = 0
        for epoch in range(EPOCHS if pages else 0):
            rate = RATE * (1 + np.cos(np.pi * epoch / EPOCHS)) / 2
            order = r.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                some = [_varied(*pages[i], foreign, r) for i in order[at:at + BATCH]]
                x, mask = padded([vectors(b) for b, _ in some])
                hide = (r.random((len(x), 1, PATH_DIM)) < 0.15) & (r.random((len(x), 1, 1)) < 0.5)
                x[:, :, :PATH_DIM] *= ~hide
                y = np.zeros(mask.shape, dtype=np.float32)
                for i, (_, labels) in enumerate(some):
                    y[i, :len(labels)] = labels
                step += 1
                for k, grad in self.gradients(x, y, mask).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * grad
                    square[k] = 0.99 * square[k] + 0.01 * grad * grad
                    self.p[k] = (self.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def labels(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page a boolean for each block; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            n = max(1, min(128, 40_000 // len(pages[order[min(len(order), at + 128) - 1]])))
            some = order[at:at + n]
            x, mask = padded([vectors(pages[i]) for i in some])
            p = self.forward(x, mask)[0]
            for row, i in zip(p, some, strict=True):
                out[i] = row[:len(pages[i])] > 0.5
            at += n
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(r) for r in rows)
    x = np.zeros((len(rows), longest, DIM), dtype=np.float32)
    mask = np.zeros((len(rows), longest), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, :len(r)] = r
        mask[i, :len(r)] = 1
    return x, mask


# Containers that training pages are varied with.
_CONTAINERS = ["main", "div.content", "div.post", "div.entry", "section.story", "div.article.text", "div.main", "article.post", "div.post.body"]
_UNWANTED = ["aside", "div.sidebar", "div.ad", "div.comments", "div.comment", "form", "div.cookie.notice", "div.related", "div.newsletter", "header",
             "div.menu", "div.share.social", "div.promo.banner", "footer", "nav", "section.comments", "div.advert", "div.widget"]


def _varied(page: list[Block], labels: list[int], foreign: list[str], r: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A training page with another container name, exchanged texts and inserted unwanted parts."""
    if r.random() < 0.5:
        name = _CONTAINERS[r.integers(len(_CONTAINERS))]
        page = [Block(tuple(name if n.split(".")[0] in CONTENT_TAGS else n for n in b.path), b.text, b.linked) for b in page]
    # Any part may hold any text, short ones too: where the path tells, the words must not overrule it.
    page = [Block(b.path, foreign[r.integers(len(foreign))], b.linked) if r.random() < 0.2 else b for b in page]
    labels = list(labels)
    for _ in range(r.integers(0, 3)):
        at = int(r.integers(0, len(page) + 1))
        outer = page[min(at, len(page) - 1)].path[:-1]
        name = _UNWANTED[r.integers(len(_UNWANTED))]
        if name == "header":
            outer = tuple(n for n in outer if n.split(".")[0] in ("html", "body"))
        more = [Block((*outer, name, *(("p",) if r.random() < 0.6 else ())), foreign[r.integers(len(foreign))], 0.0) for _ in range(r.integers(1, 5))]
        page[at:at] = more
        labels[at:at] = [0] * len(more)
    return page, labels


def train_labeller(pages: DataFrame, html: str = "html", key: str = "page_id", sample: int = SAMPLE) -> Labeller:
    """Train on the pages with the smallest id hashes; the driver receives ``sample`` pages at most."""
    some = pages.select(pages[key].alias("_id"), pages[html].alias("_html")).filter(F.length("_html") > 0)
    # Ids first, so that tasks do not send pages that are not taken: a broadcast of ``sample`` rows at most.
    ids = some.select("_id", F.xxhash64("_html").alias("_h")).orderBy(F.xxhash64("_id"), "_h").limit(sample).distinct()
    rows = (some.join(F.broadcast(ids), some["_id"].eqNullSafe(ids["_id"]) & (F.xxhash64("_html") == ids["_h"]), "left_semi")
            .dropDuplicates(["_id"]).orderBy(F.xxhash64("_id")).limit(sample).collect())
    known = []
    for r in rows:
        page = blocks(r["_html"])
        labels = [silver(b) for b in page]
        if any(labels):
            known.append((page, labels))
    return Labeller().train(known)


def extract_text(pages: DataFrame, labeller: Labeller, html: str = "html") -> DataFrame:
    """``pages`` without the html, with text (main text, empty if none) and n_chars."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), 256):
                some = [blocks(h) for h in batch[at:at + 256]]
                for page, keep in zip(some, labeller.labels(some), strict=True):
                    out.append("\n\n".join(b.text for b, k in zip(page, keep, strict=True) if k))
            yield pd.Series(out, dtype=object)

    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    done = pages.select(*kept, extract(text_or_empty(pages[html])).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
