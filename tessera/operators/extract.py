"""Page extraction (H1-H12) as per-row array expressions over a pages table.

A page is one row; its fields are arrays computed with ``regexp_extract_all`` +
``transform`` inside the row, so extraction needs no shuffle. Rules (which
element holds which field) are configuration: each rule becomes one column
expression on the driver - no join of pages against a rule table.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# HTML entities decoded in text content (ampersand last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
            ("&amp;", "&")]
# A paragraph opens at its tag and ends at its end tag, at the next block-level tag or where an element around it ends.
PARAGRAPH_OPEN = r"(?is)<p(?:\s[^>]*)?>"
PARAGRAPH_END = (r"(?is)</(?:p|address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|footer|form|header|html|li|main|nav|ol|section|table|td|th|tr|ul)\s*>"
                 r"|<(?:address|article|aside|blockquote|div|dl|fieldset|footer|form|h[1-6]|header|hr|main|nav|ol|pre|section|table|ul)(?:\s[^>]*)?/?>")
ANCHOR = r"""(?is)<a\b[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>"""
TAG = r"<[^>]*>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_entities(col) -> Column:
    c = _c(col)
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def text_content(col) -> Column:
    """Text of an HTML fragment: tags removed, entities decoded."""
    return decode_entities(F.regexp_replace(_c(col), TAG, ""))


def valid_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Drop missing and blank pages."""
    return pages.filter(F.col(html).isNotNull() & (F.col(html) != ""))


# H7
def paragraph_fragments(html) -> Column:
    """Markup inside every <p> element; an unclosed one ends where the next paragraph or block starts."""
    pieces = F.split(_c(html), PARAGRAPH_OPEN, -1)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda x: F.split(x, PARAGRAPH_END, 2)[0])


def paragraphs(html) -> Column:
    """Text of every <p> element."""
    return F.transform(paragraph_fragments(html), text_content)


def paragraph_rows(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Long form (page_id, pos, text)."""
    return pages.select(key, F.posexplode(paragraphs(F.col(html))).alias("pos", "text"))


# H8
def anchors(html) -> Column:
    """Array of struct(text, href) for each <a href=...> element."""
    hrefs = F.regexp_extract_all(_c(html), F.lit(ANCHOR), F.lit(1))
    texts = F.transform(F.regexp_extract_all(_c(html), F.lit(ANCHOR), F.lit(2)), text_content)
    return F.arrays_zip(texts.alias("text"), hrefs.alias("href"))


def anchor_rows(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    return pages.select(key, F.posexplode(anchors(F.col(html))).alias("pos", "a")).select(key, "pos", "a.text", "a.href")


# H1-H6: rule-driven element extraction
@dataclass(frozen=True)
class Rule:
    """Elements ``<tag ... attr="... value ...">`` (value matched as a whole
    class word, or exact when ``exact``); the field is the text of the
    ``inner`` elements inside each match joined by newline, or the whole
    element's text when ``inner`` is None. ``first_only`` keeps one match."""
    field: str
    tag: str
    attr: str | None = None
    value: str | None = None
    inner: str | None = None
    exact: bool = False
    first_only: bool = False
    inner_first: bool = False


def _element_pattern(rule: Rule) -> str:
    tag = T.regex_quote(rule.tag)
    if rule.attr is None:
        head = rf"<{tag}\b[^>]*>"
    else:
        val = T.regex_quote(rule.value or "")
        inside = val if rule.exact else rf"(?:[^\"]*\s)?{val}(?:\s[^\"]*)?"
        head = rf"<{tag}\b[^>]*\b{T.regex_quote(rule.attr)}\s*=\s*\"{inside}\"[^>]*>"
    # non-greedy body up to the closing tag of the same name (no nesting of the same tag)
    return rf"(?is){head}(.*?)</{tag}>"


def rule_field(html, rule: Rule) -> Column:
    blocks = F.regexp_extract_all(_c(html), F.lit(_element_pattern(rule)), F.lit(1))
    if rule.inner is None:
        vals = F.transform(blocks, text_content)
    else:
        inner = rf"(?is)<{T.regex_quote(rule.inner)}\b[^>]*>(.*?)</{T.regex_quote(rule.inner)}>"
        if rule.inner_first:
            vals = F.transform(blocks, lambda b: F.coalesce(
                T.at(F.transform(F.regexp_extract_all(b, F.lit(inner), F.lit(1)), text_content), 1), F.lit("")))
        else:
            vals = F.transform(blocks, lambda b: F.array_join(
                F.transform(F.regexp_extract_all(b, F.lit(inner), F.lit(1)), text_content), "\n"))
    if rule.first_only:
        return F.coalesce(T.at(vals, 1), F.lit(""))
    return vals


def extract_fields(pages: DataFrame, rules: list[Rule], html: str = "html", key: str = "page_id") -> DataFrame:
    """H9: one record per page with one column per rule; a blank page gives
    empty arrays (or empty strings for first-only fields)."""
    h = F.coalesce(F.col(html), F.lit(""))
    return pages.select(key, *[rule_field(h, r).alias(r.field) for r in rules])


# Rules of the known page layouts (class names as published).
QA_RULES = [Rule("questions", "td", "class", "postcell", "p"), Rule("answers", "td", "class", "answercell", "p")]
QA2_RULES = [Rule("questions", "span", "class", "rendered_qtext"), Rule("answers", "span", "class", "ui_qtext_rendered_qtext")]
ENCYCLOPEDIA_RULES = [Rule("definition", "div", "id", "encyc_entry", exact=True, first_only=True),
                      Rule("title", "span", "class", "term_title", first_only=True)]
GLOSSARY_SITE_RULES = [Rule("definition", "article", "class", "text-page", inner="p", inner_first=True, first_only=True),
                       Rule("title", "header", first_only=True)]


RELATED_DIV = r"""(?is)<div\b[^>]*\bclass\s*=\s*"[^"]*related[^"]*"[^>]*>(.*?)</div>"""


def related_links(html, container_class: str = "related", link_class: str = "question-hyperlink") -> Column:
    """H3: (text, href) of links of a class inside a div whose class contains a word."""
    div = rf"(?is)<div\b[^>]*\bclass\s*=\s*\"[^\"]*{T.regex_quote(container_class)}[^\"]*\"[^>]*>(.*?)</div>"
    blocks = F.regexp_extract_all(_c(html), F.lit(div), F.lit(1))
    link = rf"(?is)<a\b[^>]*\bclass\s*=\s*\"{T.regex_quote(link_class)}\"[^>]*>(.*?)</a>"
    href = rf"(?is)<a\b[^>]*\bclass\s*=\s*\"{T.regex_quote(link_class)}\"[^>]*?href\s*=\s*\"([^\"]*)\""
    return F.flatten(F.transform(blocks, lambda b: F.arrays_zip(
        F.transform(F.regexp_extract_all(b, F.lit(link), F.lit(1)), text_content).alias("text"),
        F.regexp_extract_all(b, F.lit(href), F.lit(1)).alias("href"))))


# H10 + W3
def glossary_blocks(para: DataFrame, is_term: Column, key: str = "page_id") -> DataFrame:
    """Gaps and islands: a term paragraph opens a block; following paragraphs
    are its definition. Input (page_id, pos, text, ...) long form; output
    (page_id, block, term, definition) cleaned with T9. Paragraphs before the
    first term are dropped. The window is per page (bounded by the page)."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (para.withColumn("_t", is_term.cast("int"))
              .withColumn("block", F.sum("_t").over(w))
              .filter(F.col("block") > 0))
    agg = blocks.groupBy(key, "block").agg(
        F.min_by("text", "pos").alias("_term"),
        F.sort_array(F.collect_list(F.when(F.col("_t") == 0, F.struct("pos", "text")))).alias("_rest"))
    return agg.select(key, "block",
                      T.glossary_clean(F.col("_term")).alias("term"),
                      T.glossary_clean(F.array_join(F.transform("_rest", lambda x: x["text"]), " ")).alias("definition"))


def text_nodes(fragment) -> Column:
    """Non-empty text nodes of an HTML fragment, in order."""
    return F.filter(F.transform(F.split(_c(fragment), TAG, -1), decode_entities), lambda t: t != F.lit(""))


# H11
def first_node_term(fragment) -> Column:
    """struct(term, definition): first text node, and the others joined by space."""
    nodes = text_nodes(fragment)
    return F.struct(T.glossary_clean(F.coalesce(T.at(nodes, 1), F.lit(""))).alias("term"),
                    T.glossary_clean(F.array_join(F.slice(nodes, 2, F.greatest(F.size(nodes), F.lit(1))), " ")).alias("definition"))


# H12
def heading_term(html, heading: str = "h2") -> Column:
    """struct(term, definition): lower-cased heading text and the first paragraph."""
    hpat = rf"(?is)<{heading}\b[^>]*>(.*?)</{heading}>"
    term = F.lower(T.glossary_clean(text_content(F.regexp_extract(_c(html), hpat, 1))))
    definition = T.glossary_clean(F.coalesce(T.at(paragraphs(html), 1), F.lit("")))
    return F.struct(term.alias("term"), definition.alias("definition"))


# T12 / H5
def title_text(html) -> Column:
    return T.strip_chars(text_content(F.regexp_extract(_c(html), r"(?is)<title\b[^>]*>(.*?)</title>", 1)))
