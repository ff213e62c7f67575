"""Stand-in glossary over the documents table, the same in Spark and in SQL (rows in the schemas that the jobs expect).

* A document with three words or more gives the term "w1 w2" (its first two letter words, lower-cased).
* Its pair, by id modulo 4: ("w1 w2", "w2 w3"), ("w1 w2", "w1"), ("w1 w2", the next document's term),
  ("w1 w2", "w1 w2s").
* Its definition line names the terms of the documents before and after it, then its text.
* Its lines are, in turn, the texts of six fields (questions, answers and related links of two sites).
* A word's vector is the row of ``embeddings`` that the word's hash picks.
* A page of each known layout is filled with a conversation's turns (``layout_pages``).
Everything grows with documents, embeddings and conversations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import phrase_vectors as PV
from ..operators.rank import md5_int
from . import bindings as B
from . import duck as D

LETTERS = r"\p{L}+"
NO_LETTERS = r"\P{L}+"
# The first three words, without reading the rest of the text.
FIRST_WORDS = r"^\P{L}*+(\p{L}++\P{L}++\p{L}++\P{L}++\p{L}++)"
CHUNK_CHARS = 64_000_000
FIELDS = ["q1", "a1", "r1", "q2", "a2", "r2"]


def documents(spark, d) -> DataFrame:
    """(doc_id, w1, w2, w3, term, text) of documents with at least three words."""
    docs = B.table(spark, d, "documents").select("doc_id", "text")
    words = F.split(F.regexp_extract(F.lower("text"), FIRST_WORDS, 1), NO_LETTERS)
    named = docs.withColumn("w", words).filter(F.size("w") == 3)
    return named.select("doc_id", *[F.col("w")[i].alias(f"w{i + 1}") for i in range(3)], F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("term"), "text")


def term_pairs(spark, d) -> DataFrame:
    """(doc_id, w1, w2) one pair a document."""
    docs = documents(spark, d)
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("term").alias("next"))
    kind = F.col("doc_id") % 4
    other = (F.when(kind == 0, F.concat_ws(" ", "w2", "w3")).when(kind == 1, F.col("w1")).when(kind == 2, F.col("next")).otherwise(F.concat(F.col("term"), F.lit("s"))))
    return docs.join(after, "doc_id", "left").select("doc_id", F.col("term").alias("w1"), other.alias("w2")).filter(F.col("w2").isNotNull())


def definition_lines(spark, d) -> DataFrame:
    """(line_no, value) lines ``term:definition``."""
    docs = documents(spark, d)
    side = lambda step, out: docs.select((F.col("doc_id") + step).alias("doc_id"), F.col("term").alias(out))
    both = docs.join(side(1, "before"), "doc_id").join(side(-1, "after"), "doc_id")
    body = F.regexp_replace("text", "[:\r\n]+", " ")
    return both.select(F.col("doc_id").alias("line_no"), F.concat("term", F.lit(":See also "), "before", F.lit(" and "), "after", F.lit(". Compare "), "before", F.lit(" with "),
                                                                  "term", F.lit(" here. "), body).alias("value"))


def field_texts(spark, d) -> DataFrame:
    """(term, field, text): a document's lines, in turn."""
    lines = documents(spark, d).select("term", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.select("term", F.get(F.array(*[F.lit(f) for f in FIELDS]), F.col("n") % len(FIELDS)).alias("field"), "text")


def word_vectors(spark, d) -> DataFrame:
    """(word, vector) of every word of the documents."""
    vectors = B.table(spark, d, "embeddings")
    n = max(1, vectors.count())
    words = B.table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word")).distinct()
    picked = words.withColumn("vec_id", md5_int(F.md5("word"), 12) % n)
    return picked.join(vectors.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("word", "vector")


def dimensions(spark, d) -> int:
    """Length of the longest vector, read from ``embeddings`` alone."""
    return PV.dimensions(B.table(spark, d, "embeddings").select(F.col("embedding").alias("vector")))


def chunks(spark, d) -> int:
    """Chunks of the fields: the shuffle partitions, more where these would hold over ``CHUNK_CHARS`` characters each."""
    chars = B.table(spark, d, "documents").agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHUNK_CHARS))


def labels(spark, d) -> DataFrame:
    """(doc_id, quality)."""
    return B.table(spark, d, "labels").filter(F.col("quality").isNotNull()).select("doc_id", "quality")


CTES = {
    "g_docs": f"""g_docs AS (SELECT doc_id, w[1] AS w1, w[2] AS w2, w[3] AS w3, w[1] || ' ' || w[2] AS term, text
        FROM (SELECT doc_id, text, regexp_extract_all(lower(text), {D.rx(LETTERS)})[1:3] AS w FROM documents) WHERE len(w) = 3)""",
    "g_pairs": """g_pairs AS (SELECT * FROM (SELECT a.doc_id, a.term AS w1, CASE a.doc_id % 4 WHEN 0 THEN a.w2 || ' ' || a.w3 WHEN 1 THEN a.w1 WHEN 2 THEN b.term ELSE a.term || 's' END AS w2
        FROM g_docs a LEFT JOIN g_docs b ON b.doc_id = a.doc_id + 1) WHERE w2 IS NOT NULL)""",
    "g_defs": f"""g_defs AS (SELECT term, arg_max(definition, line_no) AS definition FROM (SELECT x.doc_id AS line_no, x.term, 'See also ' || p.term || ' and ' || n.term || '. Compare ' || p.term
        || ' with ' || x.term || ' here. ' || {D.replace_all('x.text', '[:' + chr(13) + chr(10) + ']+', ' ')} AS definition
        FROM g_docs x JOIN g_docs p ON p.doc_id = x.doc_id - 1 JOIN g_docs n ON n.doc_id = x.doc_id + 1) GROUP BY term)""",
    "g_texts": f"""g_texts AS (SELECT term, {FIELDS}[n % {len(FIELDS)} + 1] AS field, text FROM (SELECT term, unnest(t) AS text, unnest(range(len(t))) AS n
        FROM (SELECT term, string_split(text, chr(10)) AS t FROM g_docs)))""",
    "g_vectors": f"""g_vectors AS (SELECT word, embedding AS vector FROM (SELECT word, {D.md5_int('md5(word)', 12)} % (SELECT count(*) FROM embeddings) AS vec_id FROM
        (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {D.rx('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')})) AS word FROM documents)) JOIN embeddings USING (vec_id))""",
}


def with_(extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join([*CTES.values(), *(extra or [])]) + "\n"


# Turn markup by layout (conversation id modulo 4): what users' and assistants' turns become.
# {t}: the escaped text, {s}: its first twenty characters, {c}: conversation id, {n}: turn.
LAYOUTS = [
    ('<td class="postcell"><div><p>{t}</p><table><tr><td class=\'x\'>side {n}</td></tr></table></div></td>',
     "<td class='answercell'><p>{t}</p><p>turn {n}</p></td><div class=\"side related-box\"><div>see</div><a class=\"question-hyperlink\" href='/q/{c}/{n}'>{s}</a></div>"),
    ('<h1><span class="rendered_qtext">{t}<span> ({n})</span></span></h1>', '<span class=ui_qtext_rendered_qtext>{t}</span><a href="/topic/{c}?turn={n}" class="question_link">{s}</a>'),
    ('<span class="term_title">Definition of: {s}</span>', '<div id="encyc_entry"><div class="in">{t}</div>tail{x}advert</div>'),
    ('<article class="text-page"><header>{s}</header><div><p>{t}</p></div></article>', '<article class="plain"><p>{t}</p></article>'),
]
BLANK_LINES = "\n\n\n\n"


def layout_pages(spark, d) -> DataFrame:
    """(page_id, layout, html): one page for each conversation."""
    turns = B.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    short = F.replace(F.replace(F.replace(F.substring("text", 1, 20), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = turns.withColumn("t", safe).withColumn("s", short)

    def filled(template: str):
        out = F.lit(template)
        for slot, value in (("{n}", F.col("turn").cast("string")), ("{c}", F.col("conv_id").cast("string")), ("{x}", F.lit(BLANK_LINES)), ("{s}", F.col("s")), ("{t}", F.col("t"))):
            out = F.replace(out, F.lit(slot), value)
        return out

    layout = F.col("conv_id") % len(LAYOUTS)
    piece = None
    for i, (user, other) in enumerate(LAYOUTS):
        value = F.when(F.col("role") == "user", filled(user)).otherwise(filled(other))
        piece = F.when(layout == i, value) if piece is None else piece.when(layout == i, value)
    made = rows.select("conv_id", "turn", layout.cast("int").alias("layout"), piece.alias("piece"))
    pages = made.groupBy("conv_id", "layout").agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("p"))
    return pages.select(F.col("conv_id").alias("page_id"), "layout", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("html"))


def _filled_sql(template: str) -> str:
    out = D.q(template)
    for slot, value in (("{n}", "CAST(turn AS VARCHAR)"), ("{c}", "CAST(conv_id AS VARCHAR)"), ("{x}", "repeat(chr(10), 4)"), ("{s}", "s"), ("{t}", "t")):
        out = f"replace({out}, '{slot}', {value})"
    return out


_SAFE = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
LAYOUT_SQL = f"""layout_pages AS (SELECT conv_id AS page_id, CAST(conv_id % {len(LAYOUTS)} AS INTEGER) AS layout, string_agg(CASE conv_id % {len(LAYOUTS)} {' '.join(
    f"WHEN {i} THEN CASE WHEN role = 'user' THEN {_filled_sql(u)} ELSE {_filled_sql(o)} END" for i, (u, o) in enumerate(LAYOUTS))} END, '' ORDER BY turn) AS html
    FROM (SELECT *, {_SAFE.format('text')} AS t, {_SAFE.format('left(text, 20)')} AS s FROM conversations) GROUP BY conv_id)"""


def word_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """(senses, edges): every letter word of the documents has itself and its first four letters as senses; a node's
    parents are its first half and, where its length is even, its second half."""
    words = B.table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))).alias("word")).distinct()
    senses = words.select("word", F.explode(F.array_distinct(F.array("word", F.left("word", F.lit(4))))).alias("sense"))
    half = lambda x: F.floor(F.length(x) / 2).cast("int")
    nodes = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.left("word", F.floor(F.length("word") / F.pow(F.lit(2), k)).cast("int")))).alias("child"))
    nodes = nodes.distinct().filter(F.length("child") > 1)
    parents = F.when(F.length("child") % 2 == 0, F.array(F.left("child", half("child")), F.right("child", half("child")))).otherwise(F.array(F.left("child", half("child"))))
    return senses, nodes.select("child", F.explode(parents).alias("parent")).distinct()


GRAPH_CTES = [
    f"h_words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {D.rx(LETTERS)})) AS word FROM documents)",
    "h_senses AS (SELECT word, word AS sense FROM h_words UNION SELECT word, left(word, 4) FROM h_words)",
    "h_nodes AS (SELECT DISTINCT child FROM (SELECT unnest(list_transform([1, 2, 4, 8, 16, 32], lambda k: left(word, length(word) // k))) AS child FROM h_words) WHERE length(child) > 1)",
    "h_edges AS (SELECT child, left(child, length(child) // 2) AS parent FROM h_nodes UNION SELECT child, right(child, length(child) // 2) FROM h_nodes WHERE length(child) % 2 = 0)",
]


# Stored page records: the source of a conversation by its id modulo 4; its term is that of document id / 4.
SOURCES = ["qa", "qa2", "encyclopedia", "regular"]


def page_store(spark, d) -> DataFrame:
    """(term, source, version, content): JSON page records; of several conversations of a term the last one counts."""
    turns = B.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    one = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    of = lambda role: F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: x["text"])
    links = F.transform(F.filter("t", lambda x: x["role"] == "user"), lambda x: F.array(F.substring(x["text"], 1, 20), F.concat(F.lit("/q/"), x["turn"].cast("string"))))
    asked = F.to_json(F.array(F.struct(of("user").alias("questions"), of("assistant").alias("answers"), links.alias("related_questions"))))
    defined = F.to_json(F.transform("t", lambda x: F.struct(x["text"].alias("definition"))))
    plain = F.to_json(F.array(F.struct(F.transform("t", lambda x: x["text"]).alias("content"), F.struct(F.size("t").alias("turns")).alias("other"))))
    kind = F.col("conv_id") % 4
    rows = one.select("conv_id", F.get(F.array(*[F.lit(s) for s in SOURCES]), kind).alias("source"), F.when(kind < 2, asked).when(kind == 2, defined).otherwise(plain).alias("content"))
    names = documents(spark, d).select("doc_id", "term")
    return rows.join(names, F.floor(F.col("conv_id") / 4) == F.col("doc_id")).select("term", "source", F.col("conv_id").alias("version"), "content")


STORE_CTES = [
    f"""k_rows AS (SELECT term, {SOURCES}[conv_id % 4 + 1] AS source, max(conv_id) AS conv_id FROM (SELECT DISTINCT conv_id FROM conversations) JOIN g_docs ON doc_id = conv_id // 4 GROUP BY ALL)""",
    "k_turns AS (SELECT term, source, turn, role, text, conv_id % 4 AS kind, row_number() OVER (PARTITION BY term, source, role ORDER BY turn) - 1 AS nth, row_number() OVER (PARTITION BY term, source ORDER BY turn) - 1 AS n "
    "FROM k_rows JOIN conversations USING (conv_id))",
    """k_items AS (SELECT term, source, 0 AS page_no, 'questions' AS field, nth AS item_no, text FROM k_turns WHERE kind < 2 AND role = 'user'
        UNION ALL SELECT term, source, 0, 'answers', nth, text FROM k_turns WHERE kind < 2 AND role = 'assistant'
        UNION ALL SELECT term, source, 0, 'related_questions', nth, left(text, 20) FROM k_turns WHERE kind < 2 AND role = 'user'
        UNION ALL SELECT term, source, n, 'definition', 0, text FROM k_turns WHERE kind = 2
        UNION ALL SELECT term, source, 0, 'content', n, text FROM k_turns WHERE kind = 3)""",
]
