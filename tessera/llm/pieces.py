"""SentencePiece segmentations sampled without replacement (Gumbel top-k), and decoding.

The lattice of a text has a node for each character boundary and an edge for
each vocabulary piece that fits; a character that is no piece itself has one
edge of its byte pieces. A segmentation's weight is the product of its pieces'
weights to the power ``alpha``; the model's pieces are ordered by merge rank,
and weight 1 / (rank + 10) follows from it. Backward sums turn weights into
conditional probabilities at every node.

Top-k search: every segmentation has its log probability plus Gumbel noise, and
the k largest are a sample without replacement. The perturbed A* search never
draws noise for each segmentation. Its agenda holds sets of segmentations,
each with the maximum of its members' perturbed scores: the set of all, then
for a found segmentation the sets that leave it along a stretch of its pieces,
and the remaining siblings of a piece. A set of mass m inside one of maximum g
has the maximum -log(exp(-g) + Exp(1) / m), the Gumbel of its mass truncated at
g. The search pops the best set, draws its best member top down by the
conditional probabilities (it inherits the maximum), and splits the rest; so
segmentations appear in falling order of perturbed score, all different. The
next maximum after k is the threshold kappa of the inclusion score
log P(Gumbel(log p) > kappa).

No piece spans the place before a space that follows another character, so a
text's lattice is the chain of its words' lattices. Lattices of different
words are built once per worker (bounded store), and all words of a block of
rows are drawn at once in numpy. Draws are hashes of the row key, the sample,
the word's place and the step: results do not depend on batches or reruns.

Defined results: null and empty texts have one segmentation without pieces,
probability 1 and inclusion 1; a text with fewer than k segmentations gives
them all, with inclusion 1; rows with equal key and text get equal samples;
white space is kept as it is; decoding gives the text back exactly; an empty
table gives an empty result; input columns of the same name as an output
column, in any case, give way to it. A text of any length is searched whole: a
task holds one block of rows (``BLOCK_CHARS`` bytes, or one longer text, at some
200 bytes of arrays a character) besides the words' lattices, which go when the task ends.
"""
from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, give_back_memory, text_or_empty
from .jaccard import mix

SAMPLES, ALPHA, SEED = 2, 1.0, 23
BLOCK_CHARS = 1 << 18  # bytes of the rows that are drawn together
STORE_NODES = 3 << 19  # characters of the words whose lattices a worker keeps
BUILD_CHARS = 1 << 18  # characters of the words whose lattices are built together
MARK = "▁"  # stands for a space in pieces

_BASE = 0x9E3779B97F4A7C15
_K1, _K2, _K3 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x9FB21C651E98DF25
_OWN = "\ud800"  # stands for MARK where a text itself has it; no text holds a lone surrogate
_RUNS = re.compile(" +[^ ]*|[^ ]+")


def _times(n: int, k: int) -> np.uint64:
    return np.uint64(n * k % (1 << 64))


class Table:
    """Growing parallel arrays."""

    def __init__(self, **kinds: str):
        self.kinds, self.n = kinds, 0
        self.a = {k: np.zeros(1 << 12, dtype=t) for k, t in kinds.items()}

    def extend(self, **columns: np.ndarray) -> None:
        more = len(next(iter(columns.values())))
        for k, v in columns.items():
            if self.n + more > len(self.a[k]):
                wide = np.zeros(max(len(self.a[k]) * 5 // 4, self.n + more), dtype=self.kinds[k])
                wide[:self.n] = self.a[k][:self.n]
                self.a[k] = wide
            self.a[k][self.n:self.n + more] = v
        self.n += more


class Lattices:
    """Lattices of words for one model; one per worker process."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alpha, self.keep = alpha, STORE_NODES
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in ordinary}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.text.values()):
            raise ValueError("a piece of this model spans words")
        first = ordinary[0]
        self.byte_score = -alpha * math.log(len(ordinary) + 10)
        score = {p: (i, -alpha * math.log(i - first + 10)) for i, p in self.text.items()}
        prefixes = {p[:n] for p in score for n in range(1, len(p) + 1)}
        longer = {p[:n] for p in score for n in range(1, len(p))}
        names = sorted(prefixes)
        codes = np.array([self._hash_one(n) for n in names], dtype=np.uint64)
        order = np.argsort(codes)
        self.code = codes[order]
        self.piece = np.array([score.get(n, (-1, 0))[0] for n in names], dtype=np.int32)[order]
        self.weight = np.array([score.get(n, (-1, 0.0))[1] for n in names])[order]
        self.more = np.array([n in longer for n in names])[order]
        # A direct table over the hashes' top bits; places beyond the first are walked.
        self.shift = np.uint64(64 - 20)
        self.slot = np.searchsorted(self.code, np.arange(1 << 20, dtype=np.uint64) << self.shift).astype(np.int32)
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, int] = {}
        self.unit = Table(first="i4", last="i4")
        self.node = Table(start="i4")
        self.edge = Table(step="i2", piece="i4", logp="f4", cum="f4")

    @staticmethod
    def _values(code: np.ndarray) -> np.ndarray:
        return mix((code.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))

    def _hash_one(self, s: str) -> int:
        v = self._values(np.frombuffer(s.encode("utf-32-le"), dtype="<u4"))
        up = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(len(v), np.uint64(_BASE))]), dtype=np.uint64)
        return int(mix((v * up[:-1]).sum(dtype=np.uint64, keepdims=True))[0])

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the prefixes, -1 if none."""
        at = self.slot[(h >> self.shift).astype(np.int64)]
        found = np.full(len(h), -1, dtype=np.int32)
        open_ = np.arange(len(h))
        while len(open_):
            open_ = open_[at[open_] < len(self.code)]
            c, want = self.code[at[open_]], h[open_]
            hit = c == want
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[c < want]
            at[open_] += 1
        return found

    def add(self, words: list[str]) -> None:
        """Build the lattices of new words."""
        texts = (" " + " ".join(words)).replace(MARK, _OWN).replace(" ", MARK)
        code = np.frombuffer(texts.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        last = np.cumsum(size)
        n = len(code)
        end = np.repeat(last, size)
        up = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, np.uint64(_BASE))]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))]), dtype=np.uint64)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self._values(code) * up[:-1], dtype=np.uint64)])
        open_, length = np.arange(n), 0
        nodes, steps, pieces, scores = [], [], [], []
        while len(open_):
            length += 1
            open_ = open_[open_ + length <= end[open_]]
            at = self._find(mix((total[open_ + length] - total[open_]) * down[open_]))
            known = at >= 0
            if length == 1:
                odd = open_[~known | (self.piece[np.maximum(at, 0)] < 0)]
                # Bytes of a character; MARK itself has three.
                width = np.where(code[odd] < 0x80, 1, np.where(code[odd] < 0x800, 2, np.where(code[odd] < 0x10000, 3, 4)))
                nodes.append(odd)
                steps.append(np.ones(len(odd), dtype=np.int32))
                pieces.append(-1 - code[odd].astype(np.int32))
                scores.append(self.byte_score * width)
            open_, at = open_[known], at[known]
            whole = self.piece[at] >= 0
            nodes.append(open_[whole])
            steps.append(np.full(int(whole.sum()), length, dtype=np.int32))
            pieces.append(self.piece[at[whole]])
            scores.append(self.weight[at[whole]])
            open_ = open_[self.more[at]]
        # By node, long pieces first: these are mostly the likeliest. The parts are sorted runs, which a merge sort uses.
        node, step, piece, score = (np.concatenate(x[::-1]) for x in (nodes, steps, pieces, scores))
        order = np.argsort(node, kind="stable")
        node, step, piece, score = node[order], step[order], piece[order], score[order]
        logp = self._conditional(node, step, score, end, n)
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))  # every node has an edge
        cum = np.cumsum(np.exp(logp))
        cum -= np.concatenate([[0.0], cum])[starts][node]
        cum[np.concatenate([starts[1:], [len(node)]]) - 1] = 2.0
        base, edge0 = self.node.n, self.edge.n
        self.unit.extend(first=base + last - size, last=base + last)
        self.node.extend(start=edge0 + starts)
        self.edge.extend(step=step, piece=piece, logp=logp, cum=cum)
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))

    @staticmethod
    def _conditional(node: np.ndarray, step: np.ndarray, score: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
        """log P(edge | node) from backward sums, all words side by side by distance to their ends."""
        left = end[node] - node
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        node_s, target, score_s, left_s = node[order], (node + step)[order], score[order], left[order]
        beta = np.zeros(n + 1)
        at_end = end[node_s] == target
        cuts = np.flatnonzero(np.concatenate([[True], left_s[1:] != left_s[:-1], [True]]))
        x = np.empty(len(node_s))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some = node_s[a:b]
            xs = score_s[a:b] + np.where(at_end[a:b], 0.0, beta[target[a:b]])
            firsts = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
            top = np.maximum.reduceat(xs, firsts)
            count = np.diff(np.concatenate([firsts, [b - a]]))
            total = top + np.log(np.add.reduceat(np.exp(xs - np.repeat(top, count)), firsts))
            beta[some[firsts]] = total
            x[a:b] = xs - np.repeat(total, count)
        out = np.empty(len(node))
        out[order] = x
        return out

    def units(self, text: str) -> list[str]:
        """Words of a text's lattice; each stands for a space and itself, the text's begin for one too."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [u[1:] for u in _RUNS.findall(" " + text)]

    def numbers(self, rows: list[list[str]]) -> np.ndarray:
        """Store numbers of the words of some rows, one after the other."""
        flat = list(chain.from_iterable(rows))
        out = np.fromiter(map(self.words.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        absent = np.flatnonzero(out < 0)
        if not len(absent):
            return out
        some = [flat[i] for i in absent.tolist()]
        new = set(some)
        if self.node.n + sum(map(len, new)) + len(new) > self.keep:
            self.reset()
            some, absent = flat, np.arange(len(flat))
            new = set(flat)
        words = sorted(new)
        size = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        at = 0
        while at < len(words):
            to = min(len(words), int(np.searchsorted(size, (size[at - 1] if at else 0) + BUILD_CHARS, "right")) + 1)
            self.add(words[at:to])
            at = to
        out[absent] = np.fromiter(map(self.words.__getitem__, some), dtype=np.int64, count=len(some))
        return out

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Edge of each node at cumulative probability u."""
        e = self.node.a["start"][node].astype(np.int64)
        cum = self.edge.a["cum"]
        open_ = np.flatnonzero(cum[e] <= u)
        while len(open_):
            e[open_] += 1
            open_ = open_[cum[e[open_]] <= u[open_]]
        return e

    def walk(self, node: np.ndarray, last: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw each word from its node to its end: (edges in word order, number of edges of each word)."""
        count = np.zeros(len(node), dtype=np.int64)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        who = np.flatnonzero(node < last)
        here, turn = node[who], 0
        stop, seeds = last[who], seed[who]
        while len(who):
            turn += 1
            u = (mix(seeds + _times(turn, _K3)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = self.choose(here, u)
            taken.append((who, e))
            here = here + self.edge.a["step"][e]
            go = here < stop
            if turn == 1:
                count[who] = 1
            else:
                count[who] += 1
            who, here, stop, seeds = who[go], here[go], stop[go], seeds[go]
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int64)
        for turn, (who, e) in enumerate(taken):
            out[start[who] + turn] = e
        return out, count

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path."""
        p = self.edge.a["piece"][edges]
        odd = np.flatnonzero(p < 0)
        if not len(odd):
            return p
        parts = [[self.bytes[b] for b in chr(-1 - c).replace(_OWN, MARK).encode()] for c in p[odd].tolist()]
        if all(len(x) == 1 for x in parts):
            p[odd] = [x[0] for x in parts]
            return p
        many = np.ones(len(p), dtype=np.int64)
        many[odd] = [len(x) for x in parts]
        start = np.cumsum(many) - many
        out = np.repeat(p, many)
        for i, x in zip(start[odd].tolist(), parts, strict=True):
            out[i:i + len(x)] = x
        return out


class Row:
    """A row's search: its words' places in the block, found paths and agenda."""

    def __init__(self, seed: int, lo: int, hi: int):
        self.seed, self.lo, self.hi = seed, lo, hi
        self.random = random.Random(seed)
        self.paths: list[tuple[np.ndarray, np.ndarray, float, float]] = []  # edges, words, log probability, perturbed score
        self.lead: list[np.ndarray] = []  # running log probabilities of the paths
        self.agenda: list[tuple] = []  # (-perturbed maximum, order, path, from, to, siblings already taken)
        self.pushed = 0

    def push(self, g: float, mass: float, path: int, a: int, b: int, taken: tuple = ()) -> None:
        """A set of log mass ``mass`` whose maximum is a Gumbel truncated at g."""
        if mass > -math.inf:
            wait = math.log(max(self.random.expovariate(1.0), 1e-300)) - mass
            lower = -g  # log of the parent's arrival
            arrival = max(wait, lower) + math.log1p(math.exp(-abs(wait - lower)))
            self.pushed += 1
            heapq.heappush(self.agenda, (arrival, self.pushed, path, a, b, taken))

    def stretch(self, g: float, path: int, a: int, b: int) -> None:
        """The set of segmentations that leave a path between its pieces a and b."""
        if a < b:
            lead = self.lead[path]
            gone = lead[b] - lead[a]
            if gone < 0:
                self.push(g, lead[a] + math.log(-math.expm1(gone)), path, a, b)


def _search(store: Lattices, keys: list[int], texts: list[str], k: int) -> list[list[tuple]]:
    """For each row its samples: (ids, log probability, perturbed score, log inclusion)."""
    words = [store.units(t) for t in texts]
    number = store.numbers(words)
    first, last = store.unit.a["first"][number].astype(np.int64), store.unit.a["last"][number].astype(np.int64)
    step, logp, start = store.edge.a["step"], store.edge.a["logp"], store.node.a["start"]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    hi = np.cumsum(size)
    rows = [Row(s, int(b - n), int(b)) for s, b, n in zip(keys, hi, size, strict=True)]
    place = np.arange(len(number)) - np.repeat(hi - size, size)
    seed = mix(np.repeat(np.array([s % (1 << 64) for s in keys], dtype=np.uint64), size) + place.astype(np.uint64) * np.uint64(_K1))
    # First sample: the best of all, maximum a Gumbel of mass 1.
    edges, count = store.walk(first, last, seed)
    ends = np.concatenate([[0], np.cumsum(count)])
    word_of = np.repeat(np.arange(len(number)), count)
    for r in rows:
        a, b = ends[r.lo], ends[r.hi]
        _found(r, edges[a:b], word_of[a:b], logp, -math.log(max(r.random.expovariate(1.0), 1e-300)), 0)
    for turn in range(1, k):
        begun = []
        nodes, lasts, seeds = [], [], []
        for r in rows:
            if not r.agenda:
                continue
            popped = _pop(r, store, step, logp, start, first)
            begun.append((r, *popped))
            path, j, e, w, node, g = popped
            rest = slice(w + 1, r.hi)
            nodes.append(np.concatenate([[node], first[rest]]))
            lasts.append(last[w:r.hi])
            seeds.append(seed[w:r.hi] + _times(turn, _K2))
        if not begun:
            break
        more, count = store.walk(np.concatenate(nodes), np.concatenate(lasts), mix(np.concatenate(seeds)))
        at = np.cumsum([0, *map(len, nodes)])
        ends = np.concatenate([[0], np.cumsum(count)])
        for (r, path, j, e, w, node, g), lo, hi_ in zip(begun, at[:-1], at[1:], strict=True):
            old_edges, old_words = r.paths[path][:2]
            new_words = np.repeat(np.arange(w, r.hi), count[lo:hi_])
            _found(r, np.concatenate([old_edges[:j], [e], more[ends[lo]:ends[hi_]]]), np.concatenate([old_words[:j], [w], new_words]), logp, g, j + 1)
    out = []
    for r in rows:
        kappa = -r.agenda[0][0] if r.agenda else -math.inf
        out.append([(store.ids(e), lp, g, _log_inclusion(lp, kappa)) for e, _, lp, g in r.paths])
    return out


def _found(r: Row, edges: np.ndarray, words: np.ndarray, logp: np.ndarray, g: float, free: int) -> None:
    """Record a path; what leaves it from piece ``free`` on becomes a set."""
    lead = np.concatenate([[0.0], np.cumsum(logp[edges], dtype=np.float64)])
    r.paths.append((edges, words, float(lead[-1]), g))
    r.lead.append(lead)
    r.stretch(g, len(r.paths) - 1, free, len(edges))


def _pop(r: Row, store: Lattices, step: np.ndarray, logp: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple:
    """Take the best set and split it: the piece where its best member leaves, the sibling it takes, what remains."""
    arrival, _, path, a, b, taken = heapq.heappop(r.agenda)
    g = -arrival
    lead, edges, words = r.lead[path], r.paths[path][0], r.paths[path][1]
    if not taken:
        # The piece at which the member leaves the path, by the mass that leaves there.
        keep = math.log1p(r.random.random() * math.expm1(lead[b] - lead[a]))
        j = a + min(b - a - 1, int(np.searchsorted(-(lead[a + 1:b + 1] - lead[a]), -keep)))
        while j > a and lead[j + 1] == lead[j]:
            j -= 1  # a piece without alternative
        while lead[j + 1] == lead[j]:
            j += 1
        r.stretch(g, path, a, j)
        r.stretch(g, path, j + 1, b)
        taken = (int(edges[j]),)
    else:
        j = a
    w = int(words[j])
    # Node of piece j: the word's first node and the pieces before j in it.
    i = j
    node = int(first[w])
    while i > 0 and words[i - 1] == w:
        i -= 1
    node += int(step[edges[i:j]].sum())
    stop = int(start[node + 1]) if node + 1 < store.node.n else store.edge.n
    free = [e for e in range(int(start[node]), stop) if e not in taken]
    p = np.exp(logp[free].astype(np.float64))
    at = min(len(free) - 1, int(np.searchsorted(np.cumsum(p), r.random.random() * p.sum(), side="right")))
    e = free[at]
    rest = float(p.sum() - p[at]) if len(free) > 1 else 0.0
    if rest > 0:
        r.push(g, lead[j] + math.log(rest), path, j, j, (*taken, e))
    return path, j, e, w, node + int(step[e]), g


def _log_inclusion(logp: float, kappa: float) -> float:
    d = logp - kappa
    if d > 30:
        return 0.0
    return d if d < -30 else math.log(-math.expm1(-math.exp(d)))


_WORKER: dict[tuple, Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _WORKER:
        _WORKER[path, alpha] = Lattices(path, alpha)
    return _WORKER[path, alpha]


SAMPLE_TYPE = "array<struct<ids:array<int>,log_prob:double,perturbed:double,log_inclusion:double>>"
CHECKED_TYPE = SAMPLE_TYPE.replace("double>>", "double,decoded_sha256:string,round_trip:boolean>>")


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows [a, b) that are drawn together: about ``BLOCK_CHARS`` bytes, one row at least."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_CHARS, "right")))
        yield at, to
        at = to


def encode_samples(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", k: int = SAMPLES, alpha: float = ALPHA,
                   seed: int = SEED, carry: list[str] | None = None, check: bool = False, keep: int = STORE_NODES) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all) with ``samples``: k different segmentations by falling perturbed score.

    ``keep``: characters of words whose lattices a worker holds; fewer take less memory and more time. With ``check`` each sample is decoded where it was made: SHA-256 of the decoded text, and whether it is the row's text."""
    names, rest = carried(docs, carry, ["samples"])
    rows = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("_row"), text_or_empty(docs[text]).alias("_text"), F.xxhash64(F.lit(seed), docs[key]).alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, decoder = lattices(path, alpha), Decoder(path) if check else None
        store.keep = keep
        try:
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy()
                for a, b in _blocks(sizes):
                    keys, texts = (batch.column(c).slice(a, b - a).to_pylist() for c in ("_key", "_text"))
                    found = _search(store, keys, texts, k)
                    lists = _as_arrow(found, texts, decoder)
                    yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), lists], ["_row", "samples"])
                    del found, lists
        finally:
            store.reset()
            give_back_memory()

    shape = rows.select("_row").schema
    out = rows.mapInArrow(run, T.StructType([shape["_row"], *T.StructType.fromDDL(f"samples {CHECKED_TYPE if check else SAMPLE_TYPE}")]))
    return out.select(*[F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(names)], "samples")


def _as_arrow(found: list[list[tuple]], texts: list[str], decoder: Decoder | None) -> pa.ListArray:
    """The samples of some rows as a list column."""
    samples = [s for f in found for s in f]
    ends = np.cumsum([0, *(len(s[0]) for s in samples)])
    pieces = pa.array(np.concatenate([s[0] for s in samples]).astype(np.int32))
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)
    parts, names = [ids, *[pa.array([s[i] for s in samples], pa.float64()) for i in (1, 2, 3)]], ["ids", "log_prob", "perturbed", "log_inclusion"]
    if decoder is not None:
        digests, same = [], []
        decoded = decoder.all_utf8(pieces, ends)
        for f, text in zip(found, texts, strict=True):
            want = text.encode()
            for got in islice(decoded, len(f)):
                digests.append(hashlib.sha256(got).hexdigest())
                same.append(got == want)
        parts += [pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
        names += ["decoded_sha256", "round_trip"]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays(parts, names))


class Decoder:
    """Piece ids to text."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(MARK, " ").encode()
                    for i, p in ((i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()))]
        self.column = pa.array(self.raw, pa.large_binary())

    def all_utf8(self, ids: pa.Array, ends: np.ndarray) -> Iterator[bytes]:
        """Decoded bytes of each list of piece ids between two ``ends``, all looked up at once."""
        if not len(ids):
            yield from [b""] * (len(ends) - 1)
            return
        found = self.column.take(ids)
        at = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1)[ends].tolist()
        data = memoryview(found.buffers()[2] or b"")
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield bytes(data[a + (data[a:a + 1] == b" "):b])  # the space that stands for the begin

    def utf8(self, ids: list[int]) -> bytes:
        whole = b"".join(map(self.raw.__getitem__, ids))
        return whole[1:] if whole[:1] == b" " else whole  # the space that stands for the begin

    def __call__(self, ids: list[int]) -> str:
        return self.utf8(ids).decode("utf-8", "replace")


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of a column of piece ids."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(path)
        for batch in batches:
            yield pd.Series([decoder([] if x is None else x) for x in batch], dtype=object)

    return rows.withColumn(out, run(F.col(ids)))
