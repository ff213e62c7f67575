"""Secret scans through a trigram index (native DataFrame operations only).

From each rule's regex a Boolean trigram query is derived (``derive``): exact
strings give the AND of their trigrams, alternatives an OR, anything that may
be missing or is too varied gives no condition. The index holds the trigrams
that some rule asks for, in lower case. It is partitioned by document: the
posting entries of a document stand beside its text (column ``grams``), so
postings are intersected where the text is, and neither postings nor texts are
shuffled to verify a candidate. ``posting_lists`` is the same index seen by
trigram, with the size of each list.

A rule's candidates are the documents whose postings satisfy its query; only
they are verified with the rule's regex. A rule without a mandatory trigram
(hex keys) scans every document.

Defined results: null text counts as empty and has no spans; rows that repeat
get equal spans; an empty table gives an empty result; input columns of the
same name as an output column are replaced.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, text_or_empty
from .spans import joined, let, match_spans, tagged

MOST_STRINGS = 64  # exact strings followed at once while deriving a query
MOST_CLASS = 4  # characters of a class that are still followed one by one


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` must have ``least`` characters, else the match is dropped.
    ``own``: the same matches as ``pattern`` without backtracking, for long runs."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    own: str = ""


# Headers, long words of base64 and the shorter last one; white space or written line ends between them.
_BASE64 = (r"(?:(?:\r?\nProc-Type:[^\n]*)?(?:\r?\nDEK-Info:[^\n]*)?(?:(?:[\x20\x09-\x0D]|\\[rn])+{0}[A-Za-z0-9+/=]{{16,}}{0})+{1}"
           r"(?:(?:[\x20\x09-\x0D]|\\[rn])+{0}[A-Za-z0-9+/=]+{0})?)?")

# Kinds and patterns. Where a length decides and no shorter match
# can hide a longer one, the length stands in the pattern.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    # To the END line, if no other line of five hyphens comes before it; else the base64 block.
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:-{0,4}[^-])*-----END [A-Z ]*PRIVATE KEY-----|" + _BASE64.format("", "") + ")",
         own=r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-{1,4}+(?!-))*+-----END [A-Z ]*PRIVATE KEY-----|" + _BASE64.format("+", "+") + ")"),
    Rule("hosting_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[A-Za-z0-9+.-]+://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@",
         own=r"(?:(?<![A-Za-z0-9+.-])|\G)[A-Za-z0-9+.-]++://[^\x20\x09-\x0D/:@]++:[^\x20\x09-\x0D/:@]++@"),
]

# A query is True (no condition), ("gram", g), ("and", q...) or ("or", q...).
Query = bool | tuple


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if any(p is True for p in parts) or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> Query:
    """Some of these strings is in the text."""
    return _any([_all([("gram", s[i:i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _exact(node) -> set[str] | None:
    """All strings, in lower case, that a node of the parsed regex can match, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        if any(str(o) not in ("LITERAL",) for o, _ in arg) or len(arg) > MOST_CLASS:
            return None
        return {chr(a).lower() for _, a in arg}
    if op == "SUBPATTERN":
        return _exact_all(arg[-1])
    if op == "BRANCH":
        parts = [_exact_all(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[1] == 1:
        inner = _exact_all(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _exact_all(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        more = _exact(node)
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, more)}
    return found


def _query(nodes) -> Query:
    conditions: list[Query] = []
    run = {""}  # exact strings that the nodes just before can match
    for node in nodes:
        op, arg = str(node[0]), node[1]
        more = _exact(node)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, more)}
            continue
        conditions.append(_of_strings(run))
        run = {""}
        if more is not None:
            run = more
        elif op == "SUBPATTERN":
            conditions.append(_query(arg[-1]))
        elif op == "BRANCH":
            conditions.append(_any([_query(p) for p in arg[1]]))
        elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            conditions.append(_query(arg[2]))
    return _all([*conditions, _of_strings(run)])


def derive(pattern: str) -> Query:
    """The Boolean trigram query that every match of ``pattern`` satisfies, in lower case."""
    return _query(list(re._parser.parse(pattern)))


def grams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "gram" else set().union(*[grams_of(q) for q in query[1:]])


def index_documents(docs: DataFrame, text: str, rules: list[Rule], out: str = "grams") -> DataFrame:
    """``docs`` with the posting entries of each document: the asked trigrams that it holds."""
    asked = sorted(set().union(*[grams_of(derive(r.pattern)) for r in rules]))
    low = F.lower(text_or_empty(docs[text]))
    held = let(low, lambda t: F.filter(F.array(*[F.lit(g) for g in asked]), lambda g: F.contains(t, g)))
    return docs.withColumn(out, held if asked else F.array().cast("array<string>"))


def posting_lists(indexed: DataFrame, grams: str = "grams") -> DataFrame:
    """Size of each trigram's posting list."""
    return indexed.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs"))


def candidate(query: Query, grams: Column) -> Column:
    """Whether a document's postings satisfy a query."""
    if query is True:
        return F.lit(True)
    if query[0] == "gram":
        return F.array_contains(grams, query[1])
    parts = [candidate(q, grams) for q in query[1:]]
    return reduce(lambda a, b: (a & b) if query[0] == "and" else (a | b), parts)


def verify(text: Column, rule: Rule) -> Column:
    """Spans of a rule in a candidate document."""
    found = match_spans(text, rule.own or rule.pattern)
    if not rule.least:
        return found
    return F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], rule.pattern, rule.group)) >= rule.least)


def find_secrets(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with grams (posting entries), ``secrets`` (all spans by start, then kind) and ``base_secrets``."""
    rules = RULES if rules is None else rules
    names, rest = carried(docs, None, ["grams", "secrets", "base_secrets"])
    indexed = index_documents(docs.select(*rest, text_or_empty(docs[text]).alias("_text")), "_text", rules, "_grams")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")
    found = [(r, F.when(candidate(derive(r.pattern), F.col("_grams")), tagged(verify(F.col("_text"), r), r.kind, i)).otherwise(none))
             for i, r in enumerate(rules)]
    spans = indexed.withColumn("_all", F.array_sort(F.concat(*[c for _, c in found])))
    base = [r.kind for r in rules if r.base]
    return spans.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_grams").alias("grams"), F.col("_all").alias("secrets"),
                        F.filter("_all", lambda s: s["kind"].isin(base)).alias("base_secrets"))


def redact(docs: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """Found secrets replaced by their kind in angle brackets."""
    from .spans import replaced

    return docs.withColumn(out, replaced(text_or_empty(docs[text]), F.col("secrets"), lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">"))))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    return joined(spans)
