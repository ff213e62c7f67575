"""Nested page elements (H1-H6) as column expressions: elements close at the depth at which they open.

A page is cut into its tags and the pieces of text between them, in order. For one tag name a fold over
the page's tags of that name keeps the current depth, the matching elements that are open and the spans
of those that have closed; an end tag closes the innermost open match only at its own depth, so equal
tags inside an element do not end it. A rule is a path of elements, the outermost first ("a span of this
class inside an h1"); an element counts once however many outer ones hold it.

Defined results: a null or blank page has no elements; quotes of attribute values may be double, single
or missing, names may have any case; an element without end tag runs to the end of the page, an end tag
without element is ignored; comments, scripts and styles are no text; tags are not implied (a td does not end
an open td). Work is linear in the page's tags plus one copy of the found list for each found element."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .extract import decode_entities, paragraphs

# Comments, scripts and styles whole; other tags with quoted values that may hold ">".
TAGS = (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
        r"""|<[/!?a-z][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
SPAN = "struct<start:int,end:int>"


@dataclass(frozen=True)
class Element:
    """Elements of a tag; with ``attr`` its value is ``value`` (how: "is") or has it inside ("has")."""
    tag: str
    attr: str | None = None
    value: str = ""
    how: str = "is"


@dataclass(frozen=True)
class Field:
    """Texts of the elements at ``path``: whole ("text"), or of their paragraphs, joined by a line break ("paragraphs"). ``first``: only the first, '' if none."""
    name: str
    path: tuple[Element, ...]
    parts: str = "text"
    first: bool = False


def page_tags(html: Column) -> Column:
    """struct<tags, pieces>: the page's tags, and the texts before, between and after them."""
    page = F.coalesce(html, F.lit(""))
    return F.struct(F.regexp_extract_all(page, F.lit(TAGS), F.lit(0)).alias("tags"), F.split(page, TAGS, -1).alias("pieces"))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag, null if it has none."""
    pattern = rf"""(?is)\s{T.regex_quote(name)}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(pattern), decode_entities(value))


def _matches(tag: Column, element: Element) -> Column:
    if element.attr is None:
        return F.lit(True)
    value = attribute(tag, element.attr)
    found = value.contains(element.value) if element.how == "has" else value == element.value
    return F.coalesce(found, F.lit(False))


def element_spans(tags: Column, element: Element) -> Column:
    """array<struct<start, end>> of the matching elements in page order: numbers of their start and end tags (end: number of tags if never closed)."""
    name = rf"(?is)^</?{T.regex_quote(element.tag)}(?:[\s/>])"
    own = F.filter(F.transform(tags, lambda t, i: F.struct(i.cast("int").alias("at"), t.alias("tag"))), lambda x: x["tag"].rlike(name))
    none = F.array().cast(f"array<{SPAN}>")
    state = F.struct(F.lit(0).alias("depth"), none.alias("open"), none.alias("done"))  # open: (start, depth outside)

    def step(acc: Column, x: Column) -> Column:
        opens = ~x["tag"].startswith("</")
        outside = F.greatest(acc["depth"] - 1, F.lit(0))
        top = F.element_at(acc["open"], -1)
        ends = ~opens & (F.size(acc["open"]) > 0) & F.coalesce(F.try_element_at(acc["open"], F.lit(-1))["end"] == outside, F.lit(False))
        begins = opens & _matches(x["tag"], element)
        opened = (F.when(begins, F.concat(acc["open"], F.array(F.struct(x["at"].alias("start"), acc["depth"].alias("end")))))
                  .when(ends, F.slice(acc["open"], 1, F.size(acc["open"]) - 1)).otherwise(acc["open"]))
        done = F.when(ends, F.concat(acc["done"], F.array(F.struct(top["start"].alias("start"), x["at"].alias("end"))))).otherwise(acc["done"])
        return F.struct(F.when(opens, acc["depth"] + 1).otherwise(outside).alias("depth"), opened.alias("open"), done.alias("done"))

    rest = lambda acc: F.transform(acc["open"], lambda o: F.struct(o["start"].alias("start"), F.size(tags).alias("end")))
    return F.aggregate(own, state, step, lambda acc: F.array_sort(F.concat(acc["done"], rest(acc))))


def path_spans(tags: Column, path: tuple[Element, ...]) -> Column:
    """Spans of the last element of a path that lie in spans of those before it, in order."""
    found = element_spans(tags, path[0])
    for element in path[1:]:
        outer = found
        found = F.filter(element_spans(tags, element), lambda s: F.exists(outer, lambda o: (o["start"] < s["start"]) & (s["end"] <= o["end"])))  # noqa: B023
    return found


def span_text(page: Column, span: Column) -> Column:
    """Text of an element, entities decoded."""
    return decode_entities(F.array_join(F.slice(page["pieces"], span["start"] + 2, span["end"] - span["start"]), ""))


def span_markup(page: Column, span: Column) -> Column:
    """Markup inside an element."""
    pieces = F.slice(page["pieces"], span["start"] + 2, span["end"] - span["start"])
    tags = F.slice(page["tags"], span["start"] + 2, span["end"] - span["start"] - 1)
    return F.array_join(F.zip_with(pieces, tags, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")


def field_values(page: Column, field: Field) -> Column:
    """Values of a field of a cut page (``page_tags``)."""
    if field.parts == "paragraphs":
        values = F.transform(path_spans(page["tags"], field.path), lambda s: F.array_join(paragraphs(span_markup(page, s)), "\n"))
    else:
        values = F.transform(path_spans(page["tags"], field.path), lambda s: span_text(page, s))
    return F.coalesce(T.at(values, 1), F.lit("")) if field.first else values


def page_fields(pages: DataFrame, fields: list[Field], html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (columns ``keep``, default all but the page) with one column for each field; each page is cut once."""
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    cut = pages.select(*keep, page_tags(F.col(html)).alias("_page"))
    return cut.select(*keep, *[field_values(F.col("_page"), f).alias(f.name) for f in fields])


def link_rows(pages: DataFrame, path: tuple[Element, ...], html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, text, href): one row for each link at ``path`` that has an href, in page order (pos counts all links at the path)."""
    cut = pages.select(key, page_tags(F.col(html)).alias("_page"))
    page = F.col("_page")
    links = cut.select(key, "_page", F.posexplode(path_spans(page["tags"], path)).alias("pos", "_s"))
    rows = links.select(key, "pos", span_text(page, F.col("_s")).alias("text"), attribute(F.element_at(page["tags"], F.col("_s.start") + 1), "href").alias("href"))
    return rows.filter(F.col("href").isNotNull())


# The known page layouts (tags, classes and ids as published) and their constants.
QA_SITE = [Field("questions", (Element("td", "class", "postcell"),), "paragraphs"), Field("answers", (Element("td", "class", "answercell"),), "paragraphs")]
QA_SITE_RELATED = (Element("div", "class", "related", "has"), Element("a", "class", "question-hyperlink"))
QA2_SITE = [Field("questions", (Element("h1"), Element("span", "class", "rendered_qtext"))), Field("answers", (Element("span", "class", "ui_qtext_rendered_qtext"),))]
QA2_SITE_RELATED = (Element("a", "class", "question_link"),)
ENCYCLOPEDIA = [Field("definition", (Element("div", "id", "encyc_entry"),), first=True), Field("term", (Element("span", "class", "term_title"),), first=True)]
TITLE_PREFIX = "Definition of:"
GLOSSARY_SITE = [Field("definition", (Element("article", "class", "text-page"), Element("p")), first=True),
                 Field("term", (Element("article", "class", "text-page"), Element("header")), first=True)]


def encyclopedia_records(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """H5: term without its fixed prefix, definition up to the first run of four line breaks."""
    rows = page_fields(pages, ENCYCLOPEDIA, html, keep)
    return rows.withColumn("definition", T.cut_after_blank_lines("definition")).withColumn("term", T.strip_chars(F.substring("term", len(TITLE_PREFIX) + 1, 1 << 30)))


def glossary_site_records(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """H6: header and first paragraph of the article."""
    return page_fields(pages, GLOSSARY_SITE, html, keep).withColumn("term", T.strip_chars("term"))
