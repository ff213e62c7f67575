"""Registered page-extraction queries (2.4) over the whole pages table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from . import bindings as B
from . import duck as D
from .catalog import register


def _text_content(x: str) -> str:
    c = D.replace_all(x, X.TAG, "")
    for ent, ch in X.ENTITIES:
        c = f"replace({c}, {D.q(ent)}, {D.q(ch)})"
    return c


def _pages(spark, d):
    return X.valid_pages(B.table(spark, d, "pages"))


_PARA_SQL = f"""para AS (
    SELECT page_id, pos, raw, {_text_content('raw')} AS text FROM (
      SELECT page_id, unnest(ps) AS raw, CAST(unnest(range(len(ps))) AS INTEGER) AS pos
      FROM (SELECT page_id, {D.paragraph_fragments("html")} AS ps
            FROM pages WHERE html IS NOT NULL AND html <> '')))"""


def _para(spark, d):
    p = _pages(spark, d)
    return p.select("page_id", F.posexplode(X.paragraph_fragments(F.col("html"))).alias("pos", "raw")).withColumn("text", X.text_content(F.col("raw")))


# H7
@register("pages_paragraphs", f"WITH {_PARA_SQL} SELECT page_id, pos, text FROM para")
def pages_paragraphs(spark, d):
    return _para(spark, d).select("page_id", "pos", "text")


# H8
@register("pages_anchors", f"""SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS pos, unnest(list_transform(t, lambda x: {_text_content('x')})) AS text,
    unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, {D.rx(X.ANCHOR)}, 1) AS h,
    regexp_extract_all(html, {D.rx(X.ANCHOR)}, 2) AS t FROM pages WHERE html IS NOT NULL AND html <> '')""")
def pages_anchors(spark, d):
    return X.anchor_rows(_pages(spark, d))


# H1-H6 + H9: rule fields combined into one record per page
RULES = [
    X.Rule("ad", "div", "class", "ad"),
    X.Rule("nav_items", "ul", inner="li"),
    X.Rule("headline", "h1", first_only=True),
    *X.QA_RULES,
]


def _rule_sql(r: X.Rule) -> str:
    blocks = f"regexp_extract_all(coalesce(html, ''), {D.rx(X._element_pattern(r))}, 1)"
    if r.inner is None:
        vals = f"list_transform({blocks}, lambda b: {_text_content('b')})"
    else:
        inner = rf"(?is)<{T.regex_quote(r.inner)}\b[^>]*>(.*?)</{T.regex_quote(r.inner)}>"
        if r.inner_first:
            vals = (f"list_transform({blocks}, lambda b: coalesce(list_transform("
                    f"regexp_extract_all(b, {D.rx(inner)}, 1), lambda y: {_text_content('y')})[1], ''))")
        else:
            vals = (f"list_transform({blocks}, lambda b: array_to_string(list_transform("
                    f"regexp_extract_all(b, {D.rx(inner)}, 1), lambda y: {_text_content('y')}), chr(10)))")
    if r.first_only:
        return f"coalesce({vals}[1], '')"
    return vals


@register("pages_records", "SELECT page_id, " + ", ".join(f"{_rule_sql(r)} AS {r.field}" for r in RULES)
          + f", {D.strip(_text_content('regexp_extract(html, ' + D.rx(r'(?is)<title\b[^>]*>(.*?)</title>') + ', 1)'))} AS title"
          + " FROM pages WHERE html IS NOT NULL AND html <> ''")
def pages_records(spark, d):
    p = _pages(spark, d)
    return X.extract_fields(p, RULES).join(p.select("page_id", X.title_text(F.col("html")).alias("title")), "page_id")


# H10 + W3: glossary blocks; a paragraph opening with <b> is a term
@register("pages_glossary_blocks", f"""WITH {_PARA_SQL},
    b AS (SELECT *, CAST(starts_with(raw, '<b>') AS INTEGER) AS t,
          sum(CAST(starts_with(raw, '<b>') AS INTEGER)) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block
          FROM para)
    SELECT page_id, CAST(block AS BIGINT) AS block, {D.glossary_clean('arg_min(text, pos)')} AS term,
      {D.glossary_clean("coalesce(string_agg(CASE WHEN t = 0 THEN text END, ' ' ORDER BY pos), '')")} AS definition
    FROM b WHERE block > 0 GROUP BY page_id, block""")
def pages_glossary_blocks(spark, d):
    return X.glossary_blocks(_para(spark, d), F.col("raw").startswith("<b>"))


# First text node of each paragraph is a term, the rest its definition
def _nodes_sql(x: str) -> str:
    split = f"regexp_split_to_array({x}, {D.rx(X.TAG)})"
    dec = "y"
    for ent, ch in X.ENTITIES:
        dec = f"replace({dec}, {D.q(ent)}, {D.q(ch)})"
    return f"list_filter(list_transform({split}, lambda y: {dec}), lambda z: z <> '')"


@register("pages_first_node_terms", f"""WITH {_PARA_SQL}
    SELECT page_id, pos, {D.glossary_clean("coalesce(n[1], '')")} AS term,
      {D.glossary_clean("array_to_string(n[2:], ' ')")} AS definition
    FROM (SELECT page_id, pos, {_nodes_sql('raw')} AS n FROM para)""")
def pages_first_node_terms(spark, d):
    t = _para(spark, d).select("page_id", "pos", X.first_node_term(F.col("raw")).alias("x"))
    return t.select("page_id", "pos", "x.term", "x.definition")


# Heading text as the term, first paragraph as its definition; 1-letter terms dropped
@register("pages_heading_terms", f"""SELECT * FROM (SELECT page_id,
      lower({D.glossary_clean(_text_content("regexp_extract(html, " + D.rx(r'(?is)<h1\b[^>]*>(.*?)</h1>') + ", 1)"))}) AS term,
      {D.glossary_clean("coalesce(list_transform(" + D.paragraph_fragments("html") + ", lambda x: " + _text_content('x') + ")[1], '')")} AS definition
    FROM pages WHERE html IS NOT NULL AND html <> '') WHERE length(term) > 1""")
def pages_heading_terms(spark, d):
    h = _pages(spark, d).select("page_id", X.heading_term(F.col("html"), "h1").alias("x"))
    return h.select("page_id", "x.term", "x.definition").filter(F.length("term") > 1)


# J6 + J7 + A13: links of each query's result pages (query = host of the page url)
_HOST = r"^[A-Za-z]+://([^/?#]+)"


@register("links_per_query", f"""WITH serp AS (SELECT page_id AS id, regexp_extract(url, {D.rx(_HOST)}, 1) AS query FROM pages),
    link AS (SELECT page_id AS serp_id, unnest(regexp_extract_all(html, {D.rx(X.ANCHOR)}, 1)) AS link
             FROM pages WHERE html IS NOT NULL AND html <> '')
    SELECT query, count(DISTINCT link) AS n_links, count(DISTINCT serp_id) AS n_pages
    FROM (SELECT DISTINCT s.query, l.link, l.serp_id FROM link l JOIN serp s ON l.serp_id = s.id) GROUP BY query""")
def links_per_query(spark, d):
    pages = B.table(spark, d, "pages")
    serp = pages.select(F.col("page_id").alias("id"), F.regexp_extract("url", _HOST, 1).alias("query"))
    link = X.anchor_rows(_pages(spark, d)).select(F.col("page_id").alias("serp_id"), F.col("href").alias("link"))
    j = link.join(serp, link.serp_id == serp.id).select("query", "link", "serp_id").distinct()
    return j.groupBy("query").agg(F.countDistinct("link").alias("n_links"), F.countDistinct("serp_id").alias("n_pages"))


# H3-H6: the other known layouts as rule fields (second Q/A site, encyclopedia,
# glossary site) plus the plain article's first paragraph; H5 definitions are cut
# after four newlines (T11) and titles lose a fixed prefix
SITE_RULES = [
    X.Rule("qa2_questions", "span", "class", "rendered_qtext"),
    X.Rule("qa2_answers", "span", "class", "ui_qtext_rendered_qtext"),
    X.Rule("encyc_definition", "div", "id", "encyc_entry", exact=True, first_only=True),
    X.Rule("encyc_title", "span", "class", "term_title", first_only=True),
    X.Rule("site_definition", "article", "class", "text-page", inner="p", inner_first=True, first_only=True),
    X.Rule("article_first_p", "article", inner="p", inner_first=True, first_only=True),
    X.Rule("site_title", "header", first_only=True),
]
TITLE_PREFIX = 11


@register("pages_site_rules", "SELECT page_id, " + ", ".join(
    f"{_rule_sql(r)} AS {r.field}" for r in SITE_RULES if r.field not in ("encyc_definition", "encyc_title"))
    + ", " + D.replace_all(_rule_sql(SITE_RULES[2]), "(?s)\n{4}.*$", "") + " AS encyc_definition"
    + f", trim(substring({_rule_sql(SITE_RULES[3])}, {TITLE_PREFIX + 1})) AS encyc_title"
    + f", CAST(len(regexp_extract_all(html, {D.rx(X.RELATED_DIV)}, 1)) AS INTEGER) AS n_related_blocks"
    + " FROM pages WHERE html IS NOT NULL AND html <> ''")
def pages_site_rules(spark, d):
    p = _pages(spark, d)
    f = X.extract_fields(p, SITE_RULES)
    f = (f.withColumn("encyc_definition", T.cut_after_blank_lines(F.col("encyc_definition")))
         .withColumn("encyc_title", T.strip_prefix(F.col("encyc_title"), TITLE_PREFIX)))
    rel = p.select("page_id", F.size(F.regexp_extract_all("html", F.lit(X.RELATED_DIV), F.lit(1))).alias("n_related_blocks"))
    return f.join(rel, "page_id")
