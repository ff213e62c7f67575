"""More registered queries: S9, P7, J4, A11, O3-O5, F7/F10/F11, F22."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as FT
from ..operators import folds as O
from ..operators import pairs as P
from ..operators.rank import MAX_BROADCAST_BUCKETS, global_rank, md5_int
from . import bindings as B
from . import duck as D
from .catalog import register
from .q_eval import FOLDS_SQL, PRED_SQL, _conf_sql, _ratios_sql, eval_folds
from .q_features import _bags_sql, _cosine_sql
from .q_pages import _text_content as _tc
from .sql_bindings import with_

# Category white list (P7), shard count (O3), parts (O4), seeds.
CATEGORY_WORDS = ["the", "de", "und", "la"]
SHARDS = 4
PARTS = 3
SHUFFLE_SEED = "shuffle"
BRACKET_LINE = r"""^\[\(['"](.+)['"], ['"](.+)['"]\)\]$"""


# S9 + A3: bracketed-list pair log lines, parsed and deduped without order
@register("bracket_log_pairs", with_("golden") + f"""
    , lines AS (SELECT seq, '[(''' || w1 || ''', ''' || w2 || ''')]' AS value FROM golden
                UNION ALL SELECT seq + 1, '[(''' || w2 || ''', ''' || w1 || ''')]' FROM golden)
    SELECT arg_min(a, seq) AS w1, arg_min(b, seq) AS w2, min(seq) AS seq FROM (
      SELECT seq, regexp_extract(value, {D.rx(BRACKET_LINE)}, 1) AS a, regexp_extract(value, {D.rx(BRACKET_LINE)}, 2) AS b
      FROM lines WHERE regexp_matches(value, {D.rx(BRACKET_LINE)})) GROUP BY least(a, b), greatest(a, b)""")
def bracket_log_pairs(spark, d):
    g = B.golden(spark, d)
    fwd = g.select("seq", F.concat(F.lit("[('"), "w1", F.lit("', '"), "w2", F.lit("')]")).alias("value"))
    rev = g.select((F.col("seq") + 1).alias("seq"), F.concat(F.lit("[('"), "w2", F.lit("', '"), "w1", F.lit("')]")).alias("value"))
    lines = fwd.unionByName(rev).filter(F.col("value").rlike(BRACKET_LINE))
    parsed = lines.select("seq", F.regexp_extract("value", BRACKET_LINE, 1).alias("w1"),
                          F.regexp_extract("value", BRACKET_LINE, 2).alias("w2"))
    return P.first_seen_unordered(parsed, "seq")


# Pages whose link texts (categories) contain a white-listed word
@register("pages_category_filter", f"""
    SELECT page_id, len(list_filter(c, lambda x: {' OR '.join(f"contains(x, {D.q(w)})" for w in CATEGORY_WORDS)})) > 0 AS keep
    FROM (SELECT page_id, regexp_extract_all(html, {D.rx(r'''(?is)<a\b[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>''')}, 2) AS c
          FROM pages WHERE html IS NOT NULL AND html <> '')""")
def pages_category_filter(spark, d):
    from ..operators import extract as X
    p = X.valid_pages(B.table(spark, d, "pages"))
    cats = F.regexp_extract_all("html", F.lit(X.ANCHOR), F.lit(2))
    keep = F.exists(cats, lambda c: _any([c.contains(w) for w in CATEGORY_WORDS]))
    return p.select("page_id", keep.alias("keep"))


def _any(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


# J4 + A6: attach both terms' document packs (summaries) to golden pairs; a term
# without documents gets an empty pack (0 docs) through the left joins
@register("pair_document_packs", with_("golden", "term_documents") + """
    , packs AS (SELECT term, count(*) AS n_docs, sum(length(text)) AS n_chars, count(DISTINCT source) AS n_sources
                FROM term_documents GROUP BY term)
    SELECT g.w1, g.w2, coalesce(a.n_docs, 0) AS n_docs_1, coalesce(b.n_docs, 0) AS n_docs_2,
      CAST(coalesce(a.n_chars, 0) AS BIGINT) AS n_chars_1, CAST(coalesce(b.n_chars, 0) AS BIGINT) AS n_chars_2,
      coalesce(a.n_sources, 0) AS n_sources_1, coalesce(b.n_sources, 0) AS n_sources_2
    FROM golden g LEFT JOIN packs a ON a.term = g.w1 LEFT JOIN packs b ON b.term = g.w2""")
def pair_document_packs(spark, d):
    packs = B.term_documents(spark, d).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("source").alias("n_sources"))
    g = B.golden(spark, d).select("w1", "w2")
    out = g
    for side, w in (("1", "w1"), ("2", "w2")):
        out = out.join(packs.select(F.col("term").alias(w), *[F.col(c).alias(f"{c}_{side}") for c in ("n_docs", "n_chars", "n_sources")]),
                       w, "left")
    return out.fillna(0, subset=[f"{c}_{s}" for c in ("n_docs", "n_chars", "n_sources") for s in ("1", "2")])


# Run files merged by name prefix (two rules: all but the last '_' part, or the first part)
def file_prefix(name, rule: str = "all_but_last"):
    n = F.regexp_replace(name, r"\.[^.]*$", "")
    if rule == "first":
        return F.split(n, "_", -1).getItem(0)
    return F.regexp_replace(n, r"_[^_]*$", "")


@register("merged_run_files", f"""WITH {PRED_SQL}, {FOLDS_SQL},
    pf AS (SELECT p.*, f.fold FROM pred p JOIN folds f ON f.doc_id = p.doc_id),
    fm AS ({_ratios_sql(_conf_sql("pf", "model, fold"), "model, fold")}),
    files AS (SELECT *, model || '_run_result' || CAST(fold AS VARCHAR) || '.csv' AS file FROM fm)
    SELECT regexp_replace(regexp_replace(file, '\\.[^.]*$', ''), '_[^_]*$', '') AS prefix,
      string_split(regexp_replace(file, '\\.[^.]*$', ''), '_')[1] AS first_part, count(*) AS n_rows,
      round(sum(recall), 9) AS sum_recall FROM files GROUP BY 1, 2""")
def merged_run_files(spark, d):
    fm = eval_folds(spark, d).withColumn(
        "file", F.concat(F.col("model"), F.lit("_run_result"), F.col("fold").cast("string"), F.lit(".csv")))
    return fm.groupBy(file_prefix(F.col("file")).alias("prefix"), file_prefix(F.col("file"), "first").alias("first_part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("recall"), 9).alias("sum_recall"))


# O3 + O5: shard of each term (md5 mod shards) and its position in a seeded shuffle
@register("shard_terms", with_("terms") + f"""
    SELECT term, {D.md5_int("md5(CAST(term AS VARCHAR))")} % {SHARDS} + 1 AS shard,
      row_number() OVER (ORDER BY md5('{SHUFFLE_SEED}|' || term)) - 1 AS shuffle_pos FROM terms""")
def shard_terms(spark, d):
    t = B.terms(spark, d)
    sh = t.withColumn("shard", F.pmod(md5_int(F.md5(F.col("term"))), F.lit(SHARDS)) + 1)
    sh = sh.withColumn("_h", O.shuffle_key("term", seed=SHUFFLE_SEED))
    return global_rank(sh, ["_h"], F.substring("_h", 1, 4), "shuffle_pos", bucket_bound=MAX_BROADCAST_BUCKETS).drop("_h")


# Each term's documents dealt round robin into parts, in doc id order
@register("term_docs_round_robin", with_("term_documents") + f"""
    SELECT term, doc_id, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) % {PARTS} AS part FROM term_documents""")
def term_docs_round_robin(spark, d):
    td = B.term_documents(spark, d).select("term", "doc_id")
    return O.round_robin(td, "term", "doc_id", PARTS)


# F7 + F10 + F11: definition bag cosine, and each term's own words against the other's definition
def _term_bags_sql(src: str) -> str:
    return f"""(SELECT term, tok, count(*) AS n FROM (
        SELECT term, unnest(regexp_extract_all(lower(term), {D.rx('[' + T.WORD + ']+')})) AS tok FROM {src})
      WHERE NOT list_contains({D.stop_list()}, tok) GROUP BY term, tok)"""


def _cross_cosine_sql(b1: str, b2: str, out: str, pairs: str = "golden") -> str:
    return f"""{out}_b1 AS {b1}, {out}_b2 AS {b2},
    {out}_n1 AS (SELECT term, sum(n * n) AS nn FROM {out}_b1 GROUP BY term),
    {out}_n2 AS (SELECT term, sum(n * n) AS nn FROM {out}_b2 GROUP BY term),
    {out}_dot AS (SELECT k.w1, k.w2, sum(x.n * y.n) AS dot FROM (SELECT DISTINCT w1, w2 FROM {pairs}) k
        JOIN {out}_b1 x ON x.term = k.w1 JOIN {out}_b2 y ON y.term = k.w2 AND y.tok = x.tok GROUP BY k.w1, k.w2),
    {out} AS (SELECT k.w1, k.w2, CASE WHEN d.dot IS NULL OR a.nn IS NULL OR b.nn IS NULL THEN 0.0
          ELSE d.dot / sqrt(CAST(a.nn AS DOUBLE) * CAST(b.nn AS DOUBLE)) END AS {out}
        FROM (SELECT DISTINCT w1, w2 FROM {pairs}) k LEFT JOIN {out}_dot d ON d.w1 = k.w1 AND d.w2 = k.w2
        LEFT JOIN {out}_n1 a ON a.term = k.w1 LEFT JOIN {out}_n2 b ON b.term = k.w2)"""


@register("features_definition_cosine", with_("golden", "definitions", extra=[
    "defdocs AS (SELECT term, definition AS text FROM definitions)",
    "terms_only AS (SELECT DISTINCT term FROM (SELECT w1 AS term FROM golden UNION ALL SELECT w2 FROM golden))",
    _cosine_sql(_bags_sql("defdocs"), "def_cosine"),
    _cross_cosine_sql(_term_bags_sql("terms_only"), _bags_sql("defdocs"), "w1_to_def2"),
    "golden_rev AS (SELECT w2 AS w1, w1 AS w2 FROM golden)",
    _cross_cosine_sql(_term_bags_sql("terms_only"), _bags_sql("defdocs"), "w2_to_def1_r", "golden_rev")]) + """
    SELECT c.w1, c.w2, c.def_cosine, a.w1_to_def2, r.w2_to_def1_r AS w2_to_def1
    FROM def_cosine c JOIN w1_to_def2 a ON a.w1 = c.w1 AND a.w2 = c.w2
    JOIN w2_to_def1_r r ON r.w1 = c.w2 AND r.w2 = c.w1""")
def features_definition_cosine(spark, d):
    g = B.golden(spark, d).select("w1", "w2")
    defs = B.definitions(spark, d).select("term", F.col("definition").alias("text"))
    def_bags = FT.term_bags(defs)
    terms = g.select(F.col("w1").alias("term")).unionByName(g.select(F.col("w2").alias("term"))).distinct()
    own_bags = FT.term_bags(terms.withColumn("text", F.col("term")))
    c = FT.bag_cosine(g, def_bags, "def_cosine")
    a = FT.bag_cosine(g, own_bags, "w1_to_def2", bags2=def_bags)
    rev = g.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"))
    b = FT.bag_cosine(rev, own_bags, "w2_to_def1", bags2=def_bags).select(
        F.col("w2").alias("w1"), F.col("w1").alias("w2"), "w2_to_def1")
    return c.join(a, ["w1", "w2"]).join(b, ["w1", "w2"]).select("w1", "w2", "def_cosine", "w1_to_def2", "w2_to_def1")


# related-word overlap: each side's tokens plus their synonyms from a
# token synonym table (here: last tokens of synonym relations, both ways)
@register("features_related_overlap", with_("golden", "relations", extra=[
    """syn AS (SELECT DISTINCT a AS tok, b AS rel FROM (
          SELECT split_part(w1, ' ', -1) AS a, split_part(w2, ' ', -1) AS b FROM relations WHERE kind = 'synonym'
          UNION ALL SELECT split_part(w2, ' ', -1), split_part(w1, ' ', -1) FROM relations WHERE kind = 'synonym'))""",
    f"""side AS (SELECT DISTINCT term, tok FROM (
          SELECT term, unnest({D.term_tokens('term')}) AS tok FROM (SELECT w1 AS term FROM golden UNION SELECT w2 FROM golden)))""",
    "related AS (SELECT term, tok FROM side UNION SELECT s.term, y.rel FROM side s JOIN syn y ON y.tok = s.tok)"]) + """
    SELECT g.w1, g.w2, count(b.tok) AS related_overlap FROM (SELECT DISTINCT w1, w2 FROM golden) g
    LEFT JOIN related a ON a.term = g.w1 LEFT JOIN related b ON b.term = g.w2 AND b.tok = a.tok GROUP BY g.w1, g.w2""")
def features_related_overlap(spark, d):
    rel = B.relations(spark, d).filter(F.col("kind") == "synonym")
    last = lambda c: T.at(F.split(F.col(c), " ", -1), -1)
    syn = (rel.select(last("w1").alias("tok"), last("w2").alias("rel"))
           .unionByName(rel.select(last("w2").alias("tok"), last("w1").alias("rel"))).distinct())
    g = B.golden(spark, d).select("w1", "w2").distinct()
    terms = g.select(F.col("w1").alias("term")).unionByName(g.select(F.col("w2").alias("term"))).distinct()
    return FT.related_overlap(g, terms, syn)


# F3-F6 (re-aimed): similarity of the terms' result pages, field by field:
# headlines (questions), paragraphs (answers) and link texts (related questions)
def _page_fields(spark, d):
    from ..operators import extract as X
    tp = B.term_pages(spark, d).filter(F.col("html").isNotNull() & (F.col("html") != ""))
    head = tp.select("term", X.text_content(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)).alias("text"))
    paras = tp.select("term", F.explode(X.paragraphs(F.col("html"))).alias("text"))
    links = tp.select("term", F.explode(F.transform(X.anchors(F.col("html")), lambda a: a["text"])).alias("text"))
    return head, paras, links


def _page_field_sql():
    from ..operators import extract as X
    from .q_pages import _text_content as tc
    return [
        f"pf_head AS (SELECT term, {tc(chr(39) + chr(39) + ' || regexp_extract(html, ' + D.rx(r'(?is)<h1\b[^>]*>(.*?)</h1>') + ', 1)')} AS text FROM term_pages WHERE html IS NOT NULL AND html <> '')",
        f"pf_para AS (SELECT term, {tc('p')} AS text FROM (SELECT term, unnest({D.paragraph_fragments("html")}) AS p FROM term_pages WHERE html IS NOT NULL AND html <> ''))",
        f"pf_link AS (SELECT term, {tc('a')} AS text FROM (SELECT term, unnest(regexp_extract_all(html, {D.rx(X.ANCHOR)}, 2)) AS a FROM term_pages WHERE html IS NOT NULL AND html <> ''))",
    ]


@register("features_page_cosine", with_("golden", "term_pages", extra=_page_field_sql() + [
    _cosine_sql(_bags_sql("pf_head"), "head_cosine"),
    _cosine_sql(_bags_sql("pf_para"), "para_cosine"),
    _cosine_sql(_bags_sql("pf_link"), "link_cosine")]) + """
    SELECT h.w1, h.w2, h.head_cosine, p.para_cosine, l.link_cosine FROM head_cosine h
    JOIN para_cosine p ON p.w1 = h.w1 AND p.w2 = h.w2 JOIN link_cosine l ON l.w1 = h.w1 AND l.w2 = h.w2""")
def features_page_cosine(spark, d):
    g = B.golden(spark, d).select("w1", "w2").distinct()
    head, paras, links = _page_fields(spark, d)
    h = FT.bag_cosine(g, FT.term_bags(head), "head_cosine")
    p = FT.bag_cosine(g, FT.term_bags(paras), "para_cosine")
    lk = FT.bag_cosine(g, FT.term_bags(links), "link_cosine")
    return h.join(p, ["w1", "w2"]).join(lk, ["w1", "w2"])


# 3.3 corpus collection, back half: each term's result pages -> paragraph
# content as a JSON list -> store row per (source, query); a later page of the
# same term replaces an earlier one (K6 last wins by page id)
@register("corpus_store", with_("term_pages") + f"""
    SELECT 'pages' AS source, term AS query, CAST(arg_max(content, page_id) AS VARCHAR) AS content, max(page_id) AS version FROM (
      SELECT term, page_id, to_json(list_transform({D.paragraph_fragments("html")},
        lambda x: {_tc('x')})) AS content
      FROM term_pages WHERE html IS NOT NULL AND html <> '') GROUP BY term""")
def corpus_store(spark, d):
    from ..operators import extract as X
    from ..sources import store as ST
    tp = X.valid_pages(B.term_pages(spark, d))
    rows = tp.select(F.lit("pages").alias("source"), F.col("term").alias("query"),
                     F.to_json(X.paragraphs(F.col("html"))).alias("content"), F.col("page_id").alias("version"))
    return ST.latest_per_key(rows, ["source", "query"], "version")


# J1 over whole texts: vocabulary = every distinct word of the documents,
# expansion = every distinct word bigram; each bigram meets its two words in one
# equi join (linear in the corpus); reported as the number of phrases per word
def _doc_words(spark, d):
    docs = B.table(spark, d, "documents").select(F.lower("text").alias("text"))
    return docs.select(F.regexp_extract_all("text", F.lit("[" + T.WORD + "]+"), F.lit(0)).alias("w"))


@register("document_phrase_candidates", f"""
    WITH w AS (SELECT regexp_extract_all(lower(text), {D.rx('[' + T.WORD + ']+')}) AS w FROM documents),
    vocab AS (SELECT DISTINCT unnest(w) AS term FROM w),
    bigrams AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w),
    cand AS (SELECT v.term AS w1, b.term AS w2 FROM bigrams b JOIN vocab v ON v.term = split_part(b.term, ' ', 1)
             UNION SELECT v.term, b.term FROM bigrams b JOIN vocab v ON v.term = split_part(b.term, ' ', 2))
    SELECT w1 AS word, count(*) AS n_phrases FROM cand GROUP BY w1""")
def document_phrase_candidates(spark, d):
    w = _doc_words(spark, d)
    vocab = w.select(F.explode(F.array_distinct("w")).alias("term")).distinct()
    n = F.size("w")
    bigrams = w.select(F.explode(F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(
        F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>")))
        .alias("term")).distinct()
    cands = P.candidate_pairs(vocab, bigrams)
    return cands.groupBy(F.col("w1").alias("word")).agg(F.count(F.lit(1)).alias("n_phrases"))
