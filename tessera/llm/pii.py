"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence (native DataFrame operations only).

Protected entities are the matches of four patterns. Any other word may give
one away: information-theoretic sanitisation measures how much. Over all lines
of all documents

    pmi(kind; term) = log2(N * n(term, kind) / (n(term) * n(kind)))

is the information a term discloses about a kind, and log2(N / n(kind)) is all
there is to know; their ratio is the disclosure (1: the term only occurs
beside such data). A single value (one address, one number) is a protected entity
of its own, measured the same way. A term that shares at least ``SUPPORT`` lines
with an entity, however many values these hold, is removed at a disclosure of
``REMOVE`` and generalised to its kind's name at ``GENERALISE``, on every line of the
documents that hold the entity.

Patterns run once: spans are written beside the row, with the text where there are
any. Word counts over all lines come from one aggregation with map-side sums, and
only for terms with enough shared lines. Only documents with personal data are
exploded into words with positions.

The patterns start where a run starts or where the last match ended (``\\G``),
which gives the same leftmost matches as the plain patterns and keeps long
runs linear.

Defined results: null text counts as empty and has no spans; rows that repeat
get equal spans; a word that overlaps a base span is never a term; an empty
table gives an empty result; input columns named like an output column, in any
case, give way to it. Texts are read whole; a very long one is one row's work.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, carried, checked_broadcast, materialise, text_or_empty
from .spans import let, match_spans, replaced, tagged

# Kinds in listed order and their patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
SUPPORT = 5  # lines that a term shares with an entity
REMOVE, GENERALISE = 0.9, 0.6  # disclosure thresholds


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: let(
        F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # Leading zeros do not change a part's value.
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by kind, then start."""
    def of(kind: str, order: int) -> Column:
        return F.filter(tagged(match_spans(text, PATTERNS[kind]), kind, order), lambda s: _valid(kind, s["value"]))

    return F.concat(*[of(k, i) for i, k in enumerate(KINDS)])


def _words(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)))


def _key(key: Column, text: Column) -> Column:
    """128 bits of id and text: rows that repeat both share the key; their spans are equal."""
    name = F.coalesce(F.concat(F.length(key.cast("string")).cast("string"), F.lit(":"), key.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(name, F.lit("|"), text)))


def _scanned(docs: DataFrame, text: str, key: str, rest: list[Column]) -> DataFrame:
    """_row (``rest``), _key, _base (spans of the patterns) of every row, and _text where there are any."""
    whole = text_or_empty(docs[text])
    row = F.struct(F.lit(0).alias("_"), *rest).alias("_row")
    once = let(base_spans(whole), lambda b: F.struct(b.alias("base"), F.when(F.size(b) > 0, whole).alias("text")))
    found = docs.select(row, _key(docs[key], whole).alias("_key"), once.alias("_x"))
    return materialise(found, "found").select("_row", "_key", F.col("_x.base").alias("_base"), F.col("_x.text").alias("_text"))


def _lines_with_data(held: DataFrame) -> DataFrame:
    """(_key, at, line, base spans of the line) for each line that holds a base span; ``at``: where the line starts."""
    lines = match_spans(F.col("_text"), r"[^\n]+")
    rows = held.select("_key", "_base", F.explode(lines).alias("l")).select("_key", "_base", F.col("l.start").alias("at"), F.col("l.end").alias("to"), F.col("l.value").alias("line"))
    here = rows.withColumn("_here", F.filter("_base", lambda s: (s["start"] >= F.col("at")) & (s["end"] <= F.col("to"))))
    return here.filter(F.size("_here") > 0).select("_key", "at", "line", F.col("_here").alias("_base"))


def _free_words(lines: DataFrame) -> DataFrame:
    """(_key, start, end, term, _base) of the words that overlap no base span; places are the document's."""
    words = lines.select("_key", "at", "_base", F.explode(match_spans(F.col("line"), WORD)).alias("w"))
    words = words.select("_key", "_base", (F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end"),
                         F.lower("w.value").alias("term"), "at")
    return words.filter(~F.exists("_base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))))


def _term_counts(texts: DataFrame, terms: DataFrame) -> tuple[DataFrame, int]:
    """(term, n_term: lines of ``texts`` (_text) that hold it) and the number of lines."""
    every = texts.select(F.explode(F.split("_text", "\n")).alias("line")).filter(F.col("line") != "")
    words = every.select(F.explode(_words(F.col("line"))).alias("term"))
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        words = words.join(F.broadcast(terms), "term", "left_semi")
    n_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n_lines = F.size(F.regexp_extract_all(F.col("_text"), F.lit(r"[^\n]+"), F.lit(0)))
    total = texts.agg(F.sum(n_lines.cast("long")).alias("n")).first()["n"] or 0
    return n_term, total


def _entities(rows: DataFrame, *more: str) -> DataFrame:
    """Each base span once as its kind (no value) and once as its value."""
    spans = rows.select(*more, F.explode("_base").alias("b"))
    return spans.select(*more, F.col("b.kind").alias("kind"), F.explode(F.array(F.lit(None).cast("string"), F.col("b.value"))).alias("value"))


def disclosing_terms(texts: DataFrame, lines: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(term, kind, value, disclosure) from ``least`` on; a null value stands for the whole kind. Statistics over every line of ``texts`` (_text)."""
    n_lines = F.countDistinct("_key", "at")
    beside = _entities(_free_words(lines), "term", "_key", "at")
    pairs = materialise(beside.groupBy("term", "kind", "value").agg(n_lines.alias("n_both")).filter(F.col("n_both") >= support), "word_pairs")
    n_term, total = _term_counts(texts, pairs.select("term").distinct())
    n_target = _entities(lines, "_key", "at").groupBy("kind", "value").agg(n_lines.alias("n_target")).withColumnsRenamed({"kind": "k", "value": "v"})
    joined = pairs.join(n_term, "term").join(n_target, (F.col("kind") == F.col("k")) & F.col("value").eqNullSafe(F.col("v")))
    pmi = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_term") * F.col("n_target")))
    known = F.log2(F.lit(float(total)) / F.col("n_target"))
    rated = joined.select("term", "kind", "value", F.when(known > 0, pmi / known).otherwise(F.lit(0.0)).alias("disclosure"))
    return materialise(rated.filter(F.col("disclosure") >= least), "word_terms")


def _marked(held: DataFrame, rated: DataFrame, remove: float) -> DataFrame:
    """(_key, start, end, kind: remove_ or general_ and the kind, term, disclosure) of the terms in the documents that hold their entity."""
    rated = rated.withColumnsRenamed({"kind": "k", "value": "v"})
    words = _free_words(held.select("_key", F.lit(0).alias("at"), F.col("_text").alias("line"), "_base")).drop("_base", "at")
    wanted = checked_broadcast(rated.select("term").distinct())
    holds = _entities(held, "_key").distinct()
    near = words.join(wanted, "term", "left_semi").join(rated, "term").join(
        holds.withColumnRenamed("_key", "_held"), (F.col("_key") == F.col("_held")) & (F.col("k") == F.col("kind")) & F.col("v").eqNullSafe(F.col("value")))
    best = near.groupBy("_key", "start", "end", "kind", "term").agg(F.max("disclosure").alias("disclosure"))
    named = F.concat(F.when(F.col("disclosure") >= remove, "remove_").otherwise("general_"), F.col("kind"))
    return best.select("_key", "start", "end", named.alias("kind"), "term", "disclosure")


def _found_and_marked(docs: DataFrame, text: str, key: str, rest: list[Column], support: int, remove: float, generalise: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = _scanned(docs, text, key, rest)
    held = found.filter(F.size("_base") > 0).dropDuplicates(["_key"])
    lines = materialise(_lines_with_data(held), "lines")
    rated = disclosing_terms(docs.select(text_or_empty(docs[text]).alias("_text")), lines, support, generalise)
    return found, held, _marked(held, rated, remove)


def find_private(docs: DataFrame, text: str = "text", key: str = "doc_id", support: int = SUPPORT, remove: float = REMOVE,
                 generalise: float = GENERALISE, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all) with base_private (by kind, then start) and private (the same and then the disclosing terms by start).

    A disclosing term has the kind remove_<kind> or general_<kind>."""
    names, rest = carried(docs, carry, ["base_private", "private"])
    found, _, marked = _found_and_marked(docs, text, key, rest, support, remove, generalise)
    spans = marked.select("_key", F.struct("start", F.lit(len(KINDS)).alias("order"), "end", "kind", F.col("term").alias("value")).alias("s"))
    # A document's own spans: bounded by its length.
    per_doc = spans.groupBy("_key").agg(F.array_sort(F.collect_set("s")).alias("_terms"))
    out = found.drop("_text").join(per_doc, "_key", "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")
    return out.select(*[F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_base").alias("base_private"),
                      F.concat("_base", F.coalesce("_terms", none)).alias("private"))


def disclosing_words(docs: DataFrame, text: str = "text", key: str = "doc_id", support: int = SUPPORT, remove: float = REMOVE,
                     generalise: float = GENERALISE) -> DataFrame:
    """(key, start, end, kind, term, disclosure) of each word that gives away a kind, or a single value, of the document's base spans.

    Rows of equal id and text give one row for each word."""
    _, held, marked = _found_and_marked(docs, text, key, [docs[key].alias("_id")], support, remove, generalise)
    return marked.join(held.select("_key", F.col("_row._id").alias(key)), "_key").select(key, "start", "end", "kind", "term", "disclosure")


def sanitise(found: DataFrame, text: str = "text", out: str = "sanitised") -> DataFrame:
    """Base spans become their kind in angle brackets, general terms too, removed terms vanish."""
    def by(s: Column) -> Column:
        name = F.regexp_replace(s["kind"], "^general_", "")
        return F.when(s["kind"].startswith("remove_"), "").otherwise(F.concat(F.lit("<"), name, F.lit(">")))

    return found.withColumn(out, replaced(text_or_empty(found[text]), F.array_sort("private"), by))
