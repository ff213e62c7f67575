"""DuckDB SQL fragments mirroring ``tessera.functions.text`` for the oracle.

Each helper returns SQL text for DuckDB (RE2 regex, ``'g'`` flag for replace
all). The regex class bodies are the same fixed values as the Spark side.
"""
from __future__ import annotations

from ..functions import text as T
from ..operators import extract as X


def q(s: str) -> str:
    """SQL string literal (backslashes are literal in DuckDB strings)."""
    return "'" + s.replace("'", "''") + "'"


def rx(s: str) -> str:
    """Regex literal: real control characters are written as RE2 escapes."""
    return q(s.replace("\n", r"\n").replace("\t", r"\t").replace("\r", r"\r"))


def paragraph_fragments(html: str) -> str:
    """Markup of each paragraph: tags become marks, then texts are cut at the marks."""
    marked = f"regexp_replace(regexp_replace({html}, {rx(X.PARAGRAPH_OPEN)}, chr(1), 'g'), {rx(X.PARAGRAPH_END)}, chr(2), 'g')"
    return f"list_transform(string_split({marked}, chr(1))[2:], lambda x: string_split(x, chr(2))[1])"


def replace_all(x: str, pattern: str, rep: str) -> str:
    return f"regexp_replace({x}, {rx(pattern)}, {q(rep)}, 'g')"


def merge_ws(x: str) -> str:
    return replace_all(x, "[" + T.HWS + "]+", " ")


def keep_chars(x: str, wl: str = T.DOC_WHITELIST) -> str:
    return merge_ws(replace_all(x, "[^" + wl + "]", " "))


def strip(x: str, chars: str = T.STRIP_CHARS) -> str:
    cls = "[" + T.regex_quote(chars) + "]"
    return replace_all(x, "^" + cls + "+|" + cls + "+$", "")


def clean_phrase(x: str) -> str:
    return keep_chars(strip(x), T.PHRASE_WHITELIST)


def bracket(x: str) -> str:
    return replace_all(x, r"[\[({][^\])}]*[\])}]", " ")


def glossary_clean(x: str) -> str:
    c = replace_all(x, "[\n\t\r:]", " ")
    c = bracket(c)
    c = keep_chars(c)
    c = strip(c)
    return merge_ws(c)


def term_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {rx('[' + T.WS + ']+')}), lambda t: t <> '')"


def split_tokens(x: str, pattern: str = T.TERM_SPLIT) -> str:
    return f"regexp_split_to_array({x}, {rx(pattern)})"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {rx(T.TOKEN_PATTERN)})"


def stop_list() -> str:
    return "[" + ", ".join(q(w) for w in T.STOP_WORDS) + "]"


def remove_stop_words(x: str) -> str:
    return f"array_to_string(list_filter({tokens(x)}, lambda t: NOT list_contains({stop_list()}, lower(t))), ' ')"


def see_also_clause(x: str) -> str:
    return f"regexp_extract({x}, {rx(T.SEE_ALSO_HEAD + r'([^.]+)\.')}, 1)"


def md5_int(x: str, digits: int = 15) -> str:
    return f"('0x' || substr({x}, 1, {digits}))::BIGINT"
