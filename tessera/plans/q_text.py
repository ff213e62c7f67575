"""Registered text-function queries (2.3) over whole documents and pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import bindings as B
from . import duck as D
from .catalog import register
from .sql_bindings import with_

# Search templates (two slots or one) and the site used with them.
TEMPLATES = ["what is {} in {}", "{} vs {}", "definition of {}"]
SITE = "example.org"


def _docs(spark, d):
    return B.table(spark, d, "documents").select("doc_id", "text")


def _simple(name: str, spark_fn, sql_fn):
    register(name, f"SELECT doc_id, {sql_fn('text')} AS out FROM documents")(
        lambda spark, d: _docs(spark, d).select("doc_id", spark_fn(F.col("text")).alias("out")))


_simple("text_merge_white_space", T.merge_white_space, D.merge_ws)                      # T1
_simple("text_keep_only_given_chars", T.keep_only_given_chars, D.keep_chars)            # T2
_simple("text_clean_phrase", T.clean_phrase, D.clean_phrase)                            # T3
_simple("text_remove_space_around_dash", T.remove_space_around_char,                    # T4
        lambda x: D.replace_all(x, "[" + T.WS + "]*" + T.regex_quote("-") + "[" + T.WS + "]*", "-"))
_simple("text_remove_content_in_bracket", T.remove_content_in_bracket, D.bracket)       # T5
_simple("text_escape_sql_quote", T.escape_sql_quote, lambda x: f"replace({x}, '''', '''''')")  # T6
_simple("text_remove_stop_words", T.remove_stop_words, D.remove_stop_words)             # T7
_simple("text_glossary_clean", T.glossary_clean, D.glossary_clean)                      # T9
_simple("text_cut_after_blank_lines", T.cut_after_blank_lines,                          # T11
        lambda x: D.replace_all(x, "(?s)\n{4}.*$", ""))
_simple("text_squeeze_paragraph", T.squeeze_paragraph,                                  # T13
        lambda x: D.replace_all(D.replace_all(x, "[" + T.HWS + "]+", " "), "\n(?:[" + T.HWS + "]*\n)+", "\n"))
_simple("text_see_also_clause", T.see_also_clause, D.see_also_clause)                   # T16
_simple("text_extract_ipv4", T.extract_ipv4, lambda x: f"regexp_extract({x}, {D.rx(T.IPV4)}, 0)")  # T17


# Token split keeps empty tokens
@register("text_split_tokens", f"""SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens,
    CAST(len(list_filter(toks, lambda t: t = '')) AS INTEGER) AS n_empty
    FROM (SELECT doc_id, {D.split_tokens('text')} AS toks FROM documents)""")
def text_split_tokens(spark, d):
    toks = T.split_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(toks).alias("n_tokens"),
                                  F.size(F.filter(toks, lambda t: t == F.lit(""))).alias("n_empty"))


# Clean each line of a document and join back by newline
@register("text_clean_lines", f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
    lambda x: {D.keep_chars('x')}), chr(10)) AS out FROM documents""")
def text_clean_lines(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_docs(F.split(F.col("text"), "\n", -1)).alias("out"))


# T12 + T18 + T20 + T21 over page urls / titles
@register("text_url_parts", f"""SELECT page_id,
    regexp_extract(url, '(\\.[^./]+)$', 1) AS extension,
    replace(string_split(url, '/')[-2], '_', ' ') AS topic,
    TRY_CAST(NULLIF(regexp_extract(url, '_(\\d+)\\.[^./]*$', 1), '') AS INTEGER) AS part_no,
    trim(substring(url, 8)) AS without_scheme
    FROM pages""")
def text_url_parts(spark, d):
    p = B.table(spark, d, "pages").select("page_id", "url")
    return p.select("page_id", T.file_extension("url").alias("extension"), T.topic_from_path("url").alias("topic"),
                    T.part_number("url").alias("part_no"), T.strip_prefix("url", 7).alias("without_scheme"))


# T14 + T15: query texts of terms with templates (templates exploded per term)
@register("text_query_texts", with_("terms", extra=[
    "tpl AS (SELECT unnest([" + ", ".join(D.q(t) for t in TEMPLATES) + "]) AS template)"]) + f"""
    SELECT term, template,
      CASE WHEN len(string_split(template, '{{}}')) - 1 >= 2
           THEN regexp_replace(regexp_replace(template, '\\{{\\}}', term), '\\{{\\}}', split_part(term, ' ', -1))
           ELSE regexp_replace(template, '\\{{\\}}', term) END || ' site:{SITE}' AS query,
      CASE WHEN len(string_split(template, '{{}}')) - 1 >= 2 THEN term || '|' || split_part(term, ' ', -1) ELSE term END AS query_key
    FROM terms, tpl""")
def text_query_texts(spark, d):
    t = B.terms(spark, d).select("term", F.explode(F.array(*[F.lit(x) for x in TEMPLATES])).alias("template"))
    slots = F.size(F.split(F.col("template"), r"\{\}", -1)) - 1
    last = T.at(F.split(F.col("term"), " ", -1), -1)
    args = F.when(slots >= 2, F.array(F.col("term"), last)).otherwise(F.array(F.col("term")))
    return t.select("term", "template", T.query_text(F.col("template"), args, F.lit(SITE)).alias("query"),
                    F.array_join(args, "|").alias("query_key"))


# Single-token affix predicate on the last tokens of golden pairs
@register("text_single_token_affix", with_("golden") + """
    SELECT w1, w2, a, b, (length(a) > 3 AND length(b) > 3 AND (left(a, 3) = left(b, 3) OR right(a, 3) = right(b, 3))) AS same_affix
    FROM (SELECT w1, w2, split_part(w1, ' ', -1) AS a, split_part(w2, ' ', -1) AS b FROM golden)""")
def text_single_token_affix(spark, d):
    g = B.golden(spark, d).select("w1", "w2", T.at(F.split("w1", " ", -1), -1).alias("a"),
                                   T.at(F.split("w2", " ", -1), -1).alias("b"))
    return g.withColumn("same_affix", T.single_token_same_affix(F.col("a"), F.col("b")))
