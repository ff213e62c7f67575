"""Bindings of the library's concepts to the bundled test tables.

The test tables are not a glossary, so each concept is derived from them by a
fixed, stated rule (the same rule is written in SQL for the oracle):

* terms: ``part.p_name`` (trimmed, distinct).
* pair relations ("files" synonym / contrast / related): consecutive part keys
  of the same brand; the file is chosen by the first part's type.
* list relations ("file" hyper): a LARGE part is a root; the SMALL parts among
  the next three keys are its items (an empty list is possible).
* documents of a term: ``documents`` row ``doc_id = p_partkey``;
  questions / answers: ``conversations`` user / assistant turns with
  ``conv_id = p_partkey``; definitions: ``benchmark`` item ``item_id = p_partkey``;
  result pages: ``pages`` row ``page_id = p_partkey`` (headline = question,
  paragraphs = answers, link texts = related questions).
All links are equi joins, so the work grows with the tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pairs as P
from ..sources import relations as R

# Relation file of a pair line by the part type, and file order.
PAIR_FILE_OF_TYPE = {"PROMO": "synonym", "STANDARD": "synonym", "SMALL": "contrast", "LARGE": "contrast",
                     "ECONOMY": "related", "MEDIUM": "related"}
FILE_ORDER = {"synonym": 1, "contrast": 2, "related": 3, "hyper": 4}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def term_lines(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.col("p_name").alias("value"))


def terms(spark, d) -> DataFrame:
    return R.terms_from_lines(term_lines(spark, d))


def vocabulary(spark, d) -> DataFrame:
    """Vocabulary for candidate generation: every term and every word of a term."""
    t = terms(spark, d)
    words = t.select(F.explode(T.term_tokens(F.col("term"))).alias("term"))
    return t.unionByName(words).distinct()


def _file_of_type(col):
    expr = None
    for t, f in PAIR_FILE_OF_TYPE.items():
        expr = (F.when(col == t, F.lit(f)) if expr is None else expr.when(col == t, F.lit(f)))
    return expr.otherwise(F.lit("related"))


def _order_of_file(col):
    expr = None
    for f, o in FILE_ORDER.items():
        expr = (F.when(col == f, F.lit(o)) if expr is None else expr.when(col == f, F.lit(o)))
    return expr


def pair_relation_lines(spark, d) -> DataFrame:
    """(file, file_order, line_no, value) with ``a,b`` lines."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    a = p.alias("a")
    b = p.select(F.col("p_partkey").alias("b_key"), F.col("p_name").alias("b_name"), F.col("p_brand").alias("b_brand"))
    j = a.join(b, (F.col("b_key") == F.col("p_partkey") + 1) & (F.col("b_brand") == F.col("p_brand")))
    f = _file_of_type(F.col("p_type"))
    return j.select(f.alias("file"), _order_of_file(f).alias("file_order"), F.col("p_partkey").alias("line_no"),
                    F.concat(F.col("p_name"), F.lit(","), F.col("b_name")).alias("value"))


def list_relation_lines(spark, d) -> DataFrame:
    """(file, file_order, line_no, value) with ``root: a, b`` lines."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    roots = p.filter(F.col("p_type") == "LARGE")
    out = roots
    names = []
    for off in (1, 2, 3):
        s = p.filter(F.col("p_type") == "SMALL").select(F.col("p_partkey").alias(f"k{off}"), F.col("p_name").alias(f"n{off}"))
        out = out.join(s, F.col(f"k{off}") == F.col("p_partkey") + off, "left")
        names.append(F.col(f"n{off}"))
    return out.select(F.lit("hyper").alias("file"), F.lit(FILE_ORDER["hyper"]).alias("file_order"),
                      F.col("p_partkey").alias("line_no"),
                      F.concat(F.col("p_name"), F.lit(":"), F.concat_ws(", ", *names)).alias("value"))


def relation_pairs(spark, d) -> DataFrame:
    """All parsed relation rows (w1, w2, kind, seq) from pair and list lines."""
    pl, _ = R.parse_pair_lines(pair_relation_lines(spark, d))
    pl = pl.select("w1", "w2", F.col("file").alias("kind"),
                   (F.col("file_order") * F.lit(10 ** 12) + F.col("line_no") * F.lit(1000)).alias("seq"))
    ll, _ = R.parse_list_lines(list_relation_lines(spark, d))
    ll = ll.select("w1", "w2", F.col("file").alias("kind"),
                   (F.col("file_order") * F.lit(10 ** 12) + F.col("line_no") * F.lit(1000) + F.col("item_no")).alias("seq"))
    return pl.unionByName(ll)


def relations(spark, d) -> DataFrame:
    return P.all_relations(relation_pairs(spark, d))


def golden(spark, d) -> DataFrame:
    return P.first_seen_unordered(relation_pairs(spark, d), "seq")


def term_documents(spark, d) -> DataFrame:
    """(term, doc_id, text, source) — documents linked to a term by part key."""
    p = table(spark, d, "part").select(F.col("p_partkey"), T.strip_chars(F.col("p_name")).alias("term"))
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return docs.join(p, docs.doc_id == p.p_partkey).select("term", "doc_id", "text", "source")


def term_turns(spark, d) -> DataFrame:
    """(term, conv_id, turn, role, text) — conversation turns linked by part key."""
    p = table(spark, d, "part").select(F.col("p_partkey"), T.strip_chars(F.col("p_name")).alias("term"))
    c = table(spark, d, "conversations")
    return c.join(p, c.conv_id == p.p_partkey).select("term", "conv_id", "turn", "role", "text")


def term_pages(spark, d) -> DataFrame:
    """(term, page_id, html) — pages linked to a term by part key (its result pages)."""
    p = table(spark, d, "part").select(F.col("p_partkey"), T.strip_chars(F.col("p_name")).alias("term"))
    pg = table(spark, d, "pages").select("page_id", "html")
    return pg.join(p, pg.page_id == p.p_partkey).select("term", "page_id", "html")


def term_definition_lines(spark, d) -> DataFrame:
    """``term:definition`` lines from benchmark items linked by part key."""
    p = table(spark, d, "part").select(F.col("p_partkey"), T.strip_chars(F.col("p_name")).alias("term"))
    b = table(spark, d, "benchmark")
    return b.join(p, b.item_id == p.p_partkey).select(
        F.col("item_id").alias("line_no"),
        F.concat(F.col("term"), F.lit(":"), F.regexp_replace(F.col("text"), "[\r\n]+", " ")).alias("value"))


def definitions(spark, d) -> DataFrame:
    return R.parse_definition_lines(term_definition_lines(spark, d))
