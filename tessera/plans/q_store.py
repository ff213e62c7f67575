"""Registered store / source queries (K6, K7, S5, S6, J9, A14, W5) over events,
documents, benchmark and pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from ..operators import state as S
from ..sources import store as ST
from . import bindings as B
from . import duck as D
from .catalog import register
from .sql_bindings import with_
from .q_pages import _text_content as _tc


def _events(spark, d):
    return B.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("props").alias("content"),
                                              F.col("ts").alias("version"), "event_id", "event_type")


# K6: store = view events, updated by all other events, last version wins
@register("store_upsert", """
    SELECT key, arg_max(content, (version, event_id)) AS content, max(version) AS version, arg_max(event_id, (version, event_id)) AS event_id
    FROM (SELECT user_id AS key, props AS content, ts AS version, event_id FROM events) GROUP BY key""")
def store_upsert(spark, d):
    e = _events(spark, d)
    old = e.filter(F.col("event_type") == "view").drop("event_type")
    new = e.filter(F.col("event_type") != "view").drop("event_type")
    base = ST.latest_per_key(old, ["key"], "version", "event_id")
    return ST.upsert_last_wins(base, new, ["key"], "version", "event_id")


# K7: store = last view per user; purchases inserted only for users not in it (first purchase wins)
@register("store_insert_if_absent", """
    WITH old AS (SELECT user_id AS key, arg_max(props, (ts, event_id)) AS content, max(ts) AS version,
                        arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id),
    fresh AS (SELECT user_id AS key, arg_min(props, (ts, event_id)) AS content, min(ts) AS version,
                     arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT * FROM old UNION ALL SELECT * FROM fresh WHERE key NOT IN (SELECT key FROM old)""")
def store_insert_if_absent(spark, d):
    e = _events(spark, d)
    views = e.filter(F.col("event_type") == "view").drop("event_type")
    old = ST.latest_per_key(views, ["key"], "version", "event_id")
    new = e.filter(F.col("event_type") == "purchase").drop("event_type")
    return ST.insert_if_absent(old, new, ["key"], "version", "event_id")


# JSON content decoded with a schema
@register("events_props_decode", """
    SELECT event_id, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events""")
def events_props_decode(spark, d):
    e = B.table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# S5 + A6: content of each term per source (documents linked by part key)
@register("term_source_content", with_("term_documents") + """
    SELECT term, source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM term_documents GROUP BY term, source""")
def term_source_content(spark, d):
    return ST.content_per_source(B.term_documents(spark, d))


# A6 second form: questions / answers per term flattened from conversation turns
@register("term_qa_counts", with_("term_turns") + """
    SELECT term, CAST(count_if(role = 'user') AS BIGINT) AS n_questions, CAST(count_if(role = 'assistant') AS BIGINT) AS n_answers,
      count(DISTINCT conv_id) AS n_conversations FROM term_turns GROUP BY term""")
def term_qa_counts(spark, d):
    t = B.term_turns(spark, d)
    return t.groupBy("term").agg(F.count_if(F.col("role") == "user").alias("n_questions"),
                                 F.count_if(F.col("role") == "assistant").alias("n_answers"),
                                 F.countDistinct("conv_id").alias("n_conversations"))


# Definitions imported into the store as JSON content (one record per term)
@register("definitions_store", with_("definitions") + """
    SELECT term AS key, CAST(to_json([{'term': term, 'definition': definition}]) AS VARCHAR) AS content FROM definitions""")
def definitions_store(spark, d):
    defs = B.definitions(spark, d)
    return defs.select(F.col("term").alias("key"), ST.to_json_list("term", "definition").alias("content"))


# Page record with distinct link texts as categories and the first paragraph as summary
@register("page_category_records", f"""
    SELECT page_id, CAST(len(c) AS INTEGER) AS n_categories, array_to_string(c, '|') AS categories, summary FROM (
      SELECT page_id,
        list_sort(list_distinct(list_transform(regexp_extract_all(html, {D.rx(X.ANCHOR)}, 2), lambda x: {_tc('x')}))) AS c,
        coalesce(list_transform({D.paragraph_fragments("html")}, lambda x: {_tc('x')})[1], '') AS summary
      FROM pages WHERE html IS NOT NULL AND html <> '')""")
def page_category_records(spark, d):
    p = X.valid_pages(B.table(spark, d, "pages"))
    cats = F.array_sort(F.array_distinct(F.transform(X.anchors(F.col("html")), lambda a: a["text"])))
    summary = F.coalesce(T.at(X.paragraphs(F.col("html")), 1), F.lit(""))
    return p.select("page_id", F.size(cats).alias("n_categories"), F.array_join(cats, "|").alias("categories"),
                    summary.alias("summary"))


# Keyed credit / back-off fold over each user's events (error = fail), in time order
def _credit_sql() -> str:
    return f"""WITH RECURSIVE ev AS (
        SELECT user_id, event_id, event_type <> 'error' AS ok,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      st AS (
        SELECT user_id, rn, event_id, ok, false AS skipped,
               CASE WHEN ok THEN 0 ELSE 1 END AS credit, CASE WHEN ok THEN 0 ELSE 1 END AS waiting, ok AS available
        FROM ev WHERE rn = 1
        UNION ALL
        SELECT e.user_id, e.rn, e.event_id, e.ok, s.waiting > 0 AS skipped,
               CASE WHEN s.waiting > 0 THEN s.credit WHEN e.ok THEN greatest(s.credit - 1, 0) ELSE s.credit + 1 END,
               CASE WHEN s.waiting > 0 THEN s.waiting - 1 WHEN e.ok THEN s.waiting ELSE least({S.WAIT_CAP}, s.waiting + s.credit + 1) END,
               CASE WHEN s.waiting > 0 THEN s.available WHEN e.ok THEN true ELSE false END
        FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
      SELECT user_id, event_id, ok, skipped, credit, waiting, available FROM st"""


@register("credit_fold_events", _credit_sql())
def credit_fold_events(spark, d):
    e = B.table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    f = S.credit_fold(e, "user_id", ["ts", "event_id"], "ok")
    return f.select("user_id", "event_id", "ok", "skipped", "credit", "waiting", "available")
