"""Registered queries of document packs (S5, S6, A6, J4) over stored page records with their content."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import packs as K
from . import glossary as G
from .catalog import register

# Field -> path inside an item.
FIELDS = {"questions": "$", "answers": "$", "related_questions": "$[0]", "definition": "$", "content": "$"}


def _items(spark, d):
    store = G.page_store(spark, d)
    return K.all_items(K.page_records(K.content_for_terms(store.select("term"), store, G.SOURCES)), FIELDS)


# Every term in every source, '' where it has none
@register("pack_source_content", G.with_([*G.STORE_CTES, "k_terms AS (SELECT DISTINCT term FROM g_docs)"]) + f"""
    SELECT x.term, x.source, CASE WHEN k.kind IS NULL THEN '' WHEN k.kind < 2 THEN CAST(to_json([{{'questions': q, 'answers': a, 'related_questions': r}}]) AS VARCHAR)
      WHEN k.kind = 2 THEN CAST(to_json(ds) AS VARCHAR) ELSE CAST(to_json([{{'content': c, 'other': {{'turns': len(c)}}}}]) AS VARCHAR) END AS content
    FROM (SELECT term, unnest({G.SOURCES}) AS source FROM k_terms) x LEFT JOIN (
      SELECT term, source, any_value(kind) AS kind, coalesce(list(text ORDER BY turn) FILTER (role = 'user'), []) AS q, coalesce(list(text ORDER BY turn) FILTER (role = 'assistant'), []) AS a,
        coalesce(list([left(text, 20), '/q/' || CAST(turn AS VARCHAR)] ORDER BY turn) FILTER (role = 'user'), []) AS r, list({{'definition': text}} ORDER BY turn) AS ds,
        list(text ORDER BY turn) AS c FROM k_turns GROUP BY term, source) k ON k.term = x.term AND k.source = x.source""")
def pack_source_content(spark, d):
    return K.content_for_terms(G.documents(spark, d), G.page_store(spark, d), G.SOURCES)


# S6 + A6
@register("pack_items", G.with_(G.STORE_CTES) + "SELECT term, source, CAST(page_no AS INTEGER) AS page_no, field, CAST(item_no AS INTEGER) AS item_no, text FROM k_items")
def pack_items(spark, d):
    return _items(spark, d)


# The first definition of each term
@register("pack_definitions", G.with_(G.STORE_CTES) + "SELECT term, source, arg_min(text, page_no) AS text FROM k_items WHERE field = 'definition' GROUP BY term, source")
def pack_definitions(spark, d):
    return K.first_item(_items(spark, d), "definition")


# The texts of both terms of every pair
@register("pack_pairs", G.with_([*G.STORE_CTES, """k_lists AS (SELECT term, source || '.' || field AS name, list(text ORDER BY page_no, item_no) AS texts FROM k_items GROUP BY ALL),
    k_pairs AS (SELECT DISTINCT w1, w2 FROM g_pairs)"""]) + """
    SELECT w1, w2, 1 AS side, name, texts FROM k_pairs JOIN k_lists ON term = w1 UNION ALL SELECT w1, w2, 2, name, texts FROM k_pairs JOIN k_lists ON term = w2""")
def pack_pairs(spark, d):
    pairs = G.term_pairs(spark, d).select("w1", "w2").distinct()
    rows = K.pair_packs(pairs, K.term_packs(_items(spark, d)))
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("pack1").alias("pack")), F.struct(F.lit(2).alias("side"), F.col("pack2").alias("pack")))
    return rows.select("w1", "w2", F.explode(sides).alias("s")).select("w1", "w2", "s.side", F.explode("s.pack").alias("name", "texts"))


@register("pack_pair_items", G.with_([*G.STORE_CTES, "k_pairs AS (SELECT DISTINCT w1, w2 FROM g_pairs)"]) + """
    SELECT w1, w2, side, source, CAST(page_no AS INTEGER) AS page_no, field, CAST(item_no AS INTEGER) AS item_no, text
    FROM (SELECT *, 1 AS side, w1 AS term FROM k_pairs UNION ALL SELECT *, 2, w2 FROM k_pairs) JOIN k_items USING (term)""")
def pack_pair_items(spark, d):
    return K.pair_items(G.term_pairs(spark, d), _items(spark, d))
