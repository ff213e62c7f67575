"""Text normalisation as Column -> Column expressions (all JVM-side, codegen'd).

Every function here builds a Catalyst expression; nothing runs in Python per row.
Regex classes are spelt out explicitly so Spark (java.util.regex) and other
engines (RE2) agree: Java's and RE2's ``\\s`` / ``\\w`` are ASCII-only, while the
semantics we keep are Unicode (letters, numbers, all space separators).
"""
from __future__ import annotations

import re
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay as they are for equal results)
# ---------------------------------------------------------------------------
# Horizontal whitespace: Unicode white space without the two line breaks.
HWS = r"\t\x{0B}\x{0C} \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# All whitespace.
WS = HWS + r"\n\r"
# Word characters: letters, numbers, underscore.
WORD = r"\p{L}\p{N}_"
# Default character white list for documents: word chars, - & whitespace . , ' "
DOC_WHITELIST = WORD + r"\-&" + WS + r".,'" + '"'
# Character white list for phrases / terms: word chars, - & ' whitespace
PHRASE_WHITELIST = WORD + r"\-&'" + WS
# Characters stripped from both ends of a phrase.
STRIP_CHARS = " \n\t\r"
# Token pattern for stop-word removal: a word run, or any single non-space char.
TOKEN_PATTERN = "[" + WORD + "]+|[^" + WS + "]"
# Split pattern for term tokens: whitespace or hyphen (empty tokens are kept).
TERM_SPLIT = "[" + WS + "-]"
# English stop words (the common 179-word list published with NLTK).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves "
    "he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't "
    "wouldn wouldn't"
).split()
# See-also clause head: "see", "see also", "also known as" at the start of a text.
SEE_ALSO_HEAD = r"^[" + WS + r"]*(?:(?:[sS]ee(?: also)?)|(?:[Aa]lso known as))"
# IPv4 address inside text.
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def at(arr, i: int) -> Column:
    """Array element by 1-based index (negative from the end); null when out of range."""
    return F.try_element_at(_c(arr), F.lit(i))


def regex_quote(s: str) -> str:
    """Escape a literal for use inside a Java/RE2 regex (no \\Q..\\E so it
    also works inside character classes)."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", s)


# T1
def merge_white_space(col) -> Column:
    """Collapse runs of horizontal whitespace to one space; line breaks are kept."""
    return F.regexp_replace(_c(col), "[" + HWS + "]+", " ")


# T2
def keep_only_given_chars(col, whitelist: str = DOC_WHITELIST) -> Column:
    """Replace every character outside ``whitelist`` (a regex class body) by a space, then T1."""
    return merge_white_space(F.regexp_replace(_c(col), "[^" + whitelist + "]", " "))


def strip_chars(col, chars: str = STRIP_CHARS) -> Column:
    """Strip any of ``chars`` from both ends (Python ``str.strip(chars)``)."""
    cls = "[" + regex_quote(chars) + "]"
    return F.regexp_replace(_c(col), "^" + cls + "+|" + cls + "+$", "")


# T3
def clean_phrase(col) -> Column:
    """Strip, keep word chars - & ' and whitespace, collapse spaces. No final strip."""
    return keep_only_given_chars(strip_chars(col), PHRASE_WHITELIST)


# T4
def remove_space_around_char(col, char: str = "-") -> Column:
    q = regex_quote(char)
    return F.regexp_replace(_c(col), "[" + WS + "]*" + q + "[" + WS + "]*", char.replace("\\", "\\\\").replace("$", "\\$"))


# T5
def remove_content_in_bracket(col) -> Column:
    """Drop an opening bracket of any kind up to the first closing bracket of any kind."""
    return F.regexp_replace(_c(col), r"[\[({][^\])}]*[\])}]", " ")


# T6
def escape_sql_quote(col) -> Column:
    return F.replace(_c(col), F.lit("'"), F.lit("''"))


def tokens(col) -> Column:
    """Word runs and single punctuation marks, in order."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), F.lit(0))


def stop_word_array() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def is_stop_word(tok: Column) -> Column:
    """Membership in the stop list; Catalyst turns the literal IN list into a
    hash-set lookup (InSet), so the cost per token does not grow with the list."""
    return tok.isin(STOP_WORDS)


# T7
def remove_stop_words(col) -> Column:
    """Tokenise, drop stop words case-insensitively (case kept), join by one space."""
    kept = F.filter(tokens(col), lambda t: ~is_stop_word(F.lower(t)))
    return F.array_join(kept, " ")


# T8
def split_tokens(col, pattern: str = TERM_SPLIT) -> Column:
    """Split by regex; empty tokens are kept (as Python ``re.split``)."""
    return F.split(_c(col), pattern, -1)


def term_tokens(col) -> Column:
    """Whitespace tokens of a term (Python ``str.split()``: no empty tokens)."""
    return F.filter(F.split(_c(col), "[" + WS + "]+", -1), lambda t: t != F.lit(""))


# T9
def glossary_clean(col) -> Column:
    c = F.regexp_replace(_c(col), "[\n\t\r:]", " ")
    c = remove_content_in_bracket(c)
    c = keep_only_given_chars(c)
    c = strip_chars(c)
    return merge_white_space(c)


# T10
def clean_docs(col) -> Column:
    """Clean each text of an array and join them by newline."""
    return F.array_join(F.transform(_c(col), lambda d: merge_white_space(keep_only_given_chars(d))), "\n")


# T11
def cut_after_blank_lines(col, n: int = 4) -> Column:
    """Cut the text at the first run of ``n`` newlines (to the end)."""
    return F.regexp_replace(_c(col), "(?s)\n{" + str(n) + "}.*$", "")


# T12
def strip_prefix(col, n: int) -> Column:
    return F.trim(F.substring(_c(col), F.lit(n + 1), F.length(_c(col))))


# T13
def squeeze_paragraph(col) -> Column:
    """Squeeze horizontal whitespace runs and blank-line runs."""
    c = F.regexp_replace(_c(col), "[" + HWS + "]+", " ")
    return F.regexp_replace(c, "\n(?:[" + HWS + "]*\n)+", "\n")


# T14
def query_text(template, terms, domain=None) -> Column:
    """Fill ``{}`` slots of a template with the terms in order; append `` site:domain``.

    ``terms`` is an array column. Done with ``aggregate`` over the term array so
    any number of slots works without Python."""
    filled = F.aggregate(
        _c(terms), _c(template),
        lambda acc, t: F.regexp_replace(acc, F.lit(r"(?s)^(.*?)\{\}"), F.concat(F.lit("$1"), F.regexp_replace(t, r"([\\$])", r"\\$1"))),
    )
    if domain is None:
        return filled
    d = _c(domain)
    return F.when(d.isNull() | (d == ""), filled).otherwise(F.concat(filled, F.lit(" site:"), d))


# T15
def compound_key(*cols) -> Column:
    return F.concat_ws("|", *[_c(c) for c in cols])


# T16
def see_also_clause(col) -> Column:
    """Text after a leading 'see' / 'see also' / 'also known as' up to the first period."""
    return F.regexp_extract(_c(col), SEE_ALSO_HEAD + r"([^.]+)\.", 1)


def see_also_items(col) -> Column:
    """Items of the see-also clause split on commas or the word 'and', trimmed, non-empty."""
    parts = F.split(see_also_clause(col), r",|\band\b", -1)
    return F.filter(F.transform(parts, lambda p: strip_chars(p, STRIP_CHARS)), lambda p: p != F.lit(""))


# T17
def extract_ipv4(col) -> Column:
    return F.regexp_extract(_c(col), IPV4, 0)


# T18
def file_extension(col) -> Column:
    return F.regexp_extract(_c(col), r"(\.[^./]+)$", 1)


# T19
def single_token_same_affix(w1, w2) -> Column:
    """Both sides are one token longer than 3 chars sharing a 3-char prefix or suffix."""
    t1, t2 = term_tokens(w1), term_tokens(w2)
    a, b = at(t1, 1), at(t2, 1)
    return ((F.size(t1) == 1) & (F.size(t2) == 1) & (F.length(a) > 3) & (F.length(b) > 3)
            & ((F.left(a, F.lit(3)) == F.left(b, F.lit(3))) | (F.right(a, F.lit(3)) == F.right(b, F.lit(3)))))


# T20
def topic_from_path(col) -> Column:
    """Parent directory name with underscores as spaces."""
    return F.replace(at(F.split(_c(col), "/"), -2), F.lit("_"), F.lit(" "))


# T21
def part_number(col) -> Column:
    """Number between the last '_' and the extension, null when absent."""
    s = F.regexp_extract(_c(col), r"_(\d+)\.[^./]*$", 1)
    return F.when(s == "", F.lit(None).cast("int")).otherwise(s.cast("int"))


def normalize_spaces(col) -> Column:
    """Map every Unicode space separator to an ASCII space (before T1/T2)."""
    return F.regexp_replace(_c(col), r"[\p{Z}]", " ")


def lower_all(cols: Iterable) -> list[Column]:
    return [F.lower(_c(c)) for c in cols]
