"""Token counts of whole texts, huge texts by overlap resynchronisation.

A text longer than ``HUGE`` characters is encoded in overlapping chunks with
offsets. Where two neighbours overlap, both encodings are searched for a
position that is proven to be a boundary of the whole text's encoding:

* it starts a pre-token in both (word ids change there), and
* it lies before the overlap's last pre-tokens in the left chunk, so the left
  chunk's cut end had no part in it, and
* from it on the left and right chunks agree on ``AGREE`` pre-tokens in a row.

The pre-tokeniser scans from left to right and looks one character ahead, so
from a position that it reaches in the whole text its further cuts depend only
on what follows: the right chunk, cut at that position, goes on exactly as the
whole text does. Merges never cross pre-tokens. The left chunk gives its tokens
before the position, the right chunk those from it on. If the overlap has no
such position (one enormous run), it is widened fourfold until one is found or
the chunk reaches the text's end.

Other texts are cut at single spaces that follow a character other than white
space; no pre-token spans such a cut and no special token holds a space, so a
piece has the same tokens in the text as alone. Each different piece is encoded
once per worker and its count reused.

The library is used with its defaults: no begin, end or added special tokens,
special strings inside a text become the special token, no truncation.

Defined results: null and empty texts have 0 tokens and 0 bytes; repeated rows are
counted one by one, there are no ties; an empty table gives an empty result; input
columns named like an output column, in any case, give way to it; a text of any
length is counted whole, in chunks.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, text_or_empty

HUGE = 1 << 16  # characters from which a text is encoded in overlapping chunks
CHUNK, OVERLAP, AGREE = 1 << 15, 1 << 9, 3
MEMO = 1 << 18  # pieces kept per generation; two generations are held

_CUT = re.compile(r"(?<=\S) ")
# Letters in every Unicode version: a piece of these alone is a single pre-token.
_LETTERS = 0x250
# Byte-level alphabet by rule: printable bytes stand for themselves, the others follow from U+0100 on.
_PRINTABLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class Counter:
    """Counts tokens with one tokenizer; one per worker process."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.byte_level = isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and self.tokenizer.normalizer is None
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        """Token counts of pieces; a piece that is a single pre-token goes straight to the model."""
        out, rest, merge = [0] * len(texts), [], self.tokenizer.model.tokenize
        for i, t in enumerate(texts):
            word = t[1:] if t[:1] == " " else t
            if self.byte_level and word.isalpha() and max(word) < chr(_LETTERS):
                out[i] = len(merge(t.encode().decode("latin-1").translate(_BYTES)))
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = len(e)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of texts of ordinary length."""
        cut = [_CUT.split(t) for t in texts]
        # The first piece of a text has no space before it and is kept apart from the others by a mark.
        pieces = [["\0" + p[0], *p[1:]] for p in cut]
        wanted = set().union(*pieces) - self.new.keys() if pieces else set()
        found = {w: self.old[w] for w in wanted & self.old.keys()}
        missing = list(wanted - found.keys())
        for i in range(0, len(missing), 4096):
            part = missing[i:i + 4096]
            found.update(zip(part, self.lengths([w[1:] if w[:1] == "\0" else " " + w for w in part]), strict=True))
        if len(self.new) + len(found) > MEMO:
            self.old, self.new = self.new, {}
            for p in set().union(*pieces) & self.old.keys():
                self.new[p] = self.old[p]
        self.new.update(found)
        of = self.new.__getitem__
        return [sum(map(of, p)) for p in pieces]

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    @staticmethod
    def _starts(encoding, base: int, low: int, high: int) -> list[tuple[int, int]]:
        """(start position in the whole text, token index) of the pre-tokens that start in [low, high), in order."""
        n = len(encoding)
        at = lambda i: base + encoding.token_to_chars(i)[0]
        lo, hi = 0, n
        while lo < hi:  # token starts ascend
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if at(mid) < low else (lo, mid)
        found: list[tuple[int, int]] = []
        for i in range(lo, n):
            p = at(i)
            if p >= high:
                break
            word = encoding.token_to_word(i)
            if word is not None and (i == 0 or word != encoding.token_to_word(i - 1)) and (not found or found[-1][0] != p):
                found.append((p, i))
        return found

    def huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a long text from overlapping chunks spliced at proven boundaries."""
        total, base, end = 0, 0, min(len(text), chunk)
        left = self._encode(text[base:end])
        first = 0  # index of the first token of the current chunk that counts
        wide = overlap
        while end < len(text):
            begin = end - wide
            if begin <= base:
                # No boundary in the whole chunk: the chunk itself grows.
                end, wide = min(len(text), end + 4 * (end - base)), overlap
                left = self._encode(text[base:end])
                continue
            stop = min(len(text), begin + chunk + wide)
            right = self._encode(text[begin:stop])
            at = self._splice(self._starts(left, base, begin + 1, end), self._starts(right, begin, begin + 1, end), first)
            if at is None:
                wide *= 4
                continue
            total += at[0] - first
            first, left, base, end, wide = at[1], right, begin, stop, overlap
        return total + len(left) - first

    @staticmethod
    def _splice(left: list[tuple[int, int]], right: list[tuple[int, int]], first: int) -> tuple[int, int] | None:
        """(left token index, right token index) at the last proven common boundary of an overlap."""
        place = {p: j for j, (p, _) in enumerate(right)}
        # The last two pre-tokens may be shaped by the cut end.
        for i in range(len(left) - 2 - AGREE, -1, -1):
            j = place.get(left[i][0])
            if j is not None and left[i][1] > first and [p for p, _ in left[i:i + AGREE]] == [p for p, _ in right[j:j + AGREE]]:
                return left[i][1], right[j][1]
        return None


_WORKER: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _WORKER:
        _WORKER[path] = Counter(path)
    return _WORKER[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None, limit: int = 512) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all but the text) with n_bytes, n_tokens and over_limit."""
    names, rest = carried(docs, [c for c in (docs.columns if carry is None else carry) if c != text], ["n_bytes", "n_tokens", "over_limit"])
    rows = docs.select(*rest, text_or_empty(docs[text]).alias("_text"))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for batch in batches:
            texts = batch.tolist()
            out = [0] * len(texts)
            some: list[int] = []
            size = 0
            for i, t in enumerate(texts):
                if len(t) > HUGE:
                    out[i] = c.huge(t)
                    continue
                some.append(i)
                size += len(t)
                if size > 1 << 20:
                    for k, n in zip(some, c.counts([texts[k] for k in some]), strict=True):
                        out[k] = n
                    some, size = [], 0
            for k, n in zip(some, c.counts([texts[k] for k in some]), strict=True):
                out[k] = n
            yield pd.Series(out, dtype="int64")

    counted = F.pandas_udf(count, "long")
    found = rows.select("*", F.octet_length("_text").cast("long").alias("_bytes"), counted(F.col("_text")).alias("_tokens"))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"),
                        (F.col("_tokens") > limit).alias("over_limit"))
