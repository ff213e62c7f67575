"""Registered queries of the known page layouts (H1-H6) over pages with nested elements made of the conversations.

The oracle finds elements by another rule: running sums of opened and closed tags, joined to the first end tag at the same depth."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import containers as C
from . import duck as D
from . import glossary as G
from .catalog import register
from .q_pages import _text_content

_TAGS = (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>" r"""|<[/!?a-z][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
_CUT = f"cut AS (SELECT page_id, layout, regexp_extract_all(html, {D.rx(_TAGS)}) AS tags, string_split_regex(html, {D.rx(_TAGS)}) AS pieces FROM layout_pages)"
_TOKENS = "tok AS (SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags))) AS i FROM cut)"


def _attr(tag: str, name: str) -> str:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = " || ".join(f"regexp_extract({tag}, {D.rx(pattern)}, {i})" for i in (1, 2, 3))
    return f"CASE WHEN regexp_matches({tag}, {D.rx(pattern)}) THEN {value} END"


def _spans(name: str, e: C.Element) -> list[str]:
    name_rx = rf"(?is)^</?{e.tag}[\s/>]"
    test = "true" if e.attr is None else (f"contains({_attr('tag', e.attr)}, {D.q(e.value)})" if e.how == "has" else f"{_attr('tag', e.attr)} = {D.q(e.value)}")
    return [f"{name}_run AS (SELECT *, sum(d) OVER (PARTITION BY page_id ORDER BY i) AS deep FROM (SELECT *, CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END AS d FROM tok "
            f"WHERE regexp_matches(tag, {D.rx(name_rx)})))",
            f"{name} AS (SELECT o.page_id, o.i AS a, min(c.i) AS z FROM {name}_run o JOIN {name}_run c ON c.page_id = o.page_id AND c.i > o.i AND c.d = -1 AND c.deep = o.deep - 1 "
            f"WHERE o.d = 1 AND {test.replace('tag', 'o.tag')} GROUP BY o.page_id, o.i)"]


def _path(name: str, path: tuple[C.Element, ...]) -> list[str]:
    parts = _spans(f"{name}0", path[0])
    for k, e in enumerate(path[1:], 1):
        parts += _spans(f"{name}{k}e", e)
        parts.append(f"{name}{k} AS (SELECT DISTINCT s.* FROM {name}{k}e s JOIN {name}{k - 1} o ON o.page_id = s.page_id AND o.a < s.a AND s.z <= o.z)")
    return [*parts, f"{name} AS (SELECT s.*, cut.tags, cut.pieces FROM {name}{len(path) - 1} s JOIN cut USING (page_id))"]


_TEXT = _text_content("array_to_string(pieces[a + 2 : z + 1], '')")
_MARKUP = "array_to_string(list_transform(range(a + 2, z + 2), lambda j: pieces[j] || CASE WHEN j <= z THEN tags[j] ELSE '' END), '')"
_PARAS = f"array_to_string(list_transform({D.paragraph_fragments(_MARKUP)}, lambda x: {_text_content('x')}), chr(10))"


def _values(name: str, f: C.Field) -> str:
    text = _PARAS if f.parts == "paragraphs" else _TEXT
    value = f"list({text} ORDER BY a)" + ("[1]" if f.first else "")
    return f"{name}_v AS (SELECT page_id, {value} AS {f.name} FROM {name} GROUP BY page_id)"


def _record_sql(layout: int, fields: list[C.Field], shown: dict[str, str] | None = None) -> str:
    parts = [G.LAYOUT_SQL, _CUT, _TOKENS]
    for k, f in enumerate(fields):
        parts += [*_path(f"f{k}x", f.path), _values(f"f{k}x", f)]
    cols = ", ".join(f"{(shown or {}).get(f.name, '{}').format(f'coalesce({f.name}, ' + (chr(39) * 2 if f.first else '[]') + ')')} AS {f.name}" for f in fields)
    joins = " ".join(f"LEFT JOIN f{k}x_v USING (page_id)" for k in range(len(fields)))
    return "WITH " + ",\n".join(parts) + f"\nSELECT page_id, {cols} FROM layout_pages {joins} WHERE layout = {layout}"


def _pages(spark, d, layout: int):
    return G.layout_pages(spark, d).filter(F.col("layout") == layout).select("page_id", "html")


# H1, H2
@register("layout_qa_site", _record_sql(0, C.QA_SITE))
def layout_qa_site(spark, d):
    return C.page_fields(_pages(spark, d, 0), C.QA_SITE)


# H4
@register("layout_qa2_site", _record_sql(1, C.QA2_SITE))
def layout_qa2_site(spark, d):
    return C.page_fields(_pages(spark, d, 1), C.QA2_SITE)


# H5
@register("layout_encyclopedia", _record_sql(2, C.ENCYCLOPEDIA, {
    "definition": D.replace_all("{}", "(?s)\n{{4}}.*$", ""), "term": D.strip(f"substring({{}}, {len(C.TITLE_PREFIX) + 1})")}))
def layout_encyclopedia(spark, d):
    return C.encyclopedia_records(_pages(spark, d, 2))


# H6
@register("layout_glossary_site", _record_sql(3, C.GLOSSARY_SITE, {"term": D.strip("{}")}))
def layout_glossary_site(spark, d):
    return C.glossary_site_records(_pages(spark, d, 3))


# H3 and the links of H4: one row a link
def _links_sql(layout: int, path: tuple[C.Element, ...]) -> str:
    parts = [G.LAYOUT_SQL, _CUT, _TOKENS, *_path("l", path)]
    href = _attr("tags[a + 1]", "href")
    return ("WITH " + ",\n".join(parts) + f"\nSELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY a) - 1 AS INTEGER) AS pos, {_TEXT} AS text, {href} AS href "
            f"FROM l JOIN layout_pages USING (page_id) WHERE layout = {layout}")


@register("layout_related_links", _links_sql(0, C.QA_SITE_RELATED))
def layout_related_links(spark, d):
    return C.link_rows(_pages(spark, d, 0), C.QA_SITE_RELATED)


@register("layout_question_links", _links_sql(1, C.QA2_SITE_RELATED))
def layout_question_links(spark, d):
    return C.link_rows(_pages(spark, d, 1), C.QA2_SITE_RELATED)
