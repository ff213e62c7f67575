"""Document packs of terms (S5, S6, A6, J4): the stored page records of every source, with their content.

The store holds one JSON text for each (term, source): a list of page records whose shape depends on
the source. Records are read as VARIANT, so a record of an unknown shape, or one broken field, neither fails the job
nor loses the rest. Content stays in long rows (term, source, page_no, field, item_no, text) until the last
step; ``term_packs`` folds a term's rows into one map only where a whole pack is asked for.

Defined results: a term without a row in a source has the content '' there; blank, null or malformed
content has no records; a record that is no object has no fields; a field that is no list is a list of one,
null items are dropped; of several rows of a (term, source) the one with the largest version counts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_for_terms(terms: DataFrame, store: DataFrame, sources: list[str]) -> DataFrame:
    """(term, source, content) of every term in every source; '' where the store has none."""
    every = terms.select("term").distinct().select("term", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    found = store.groupBy("term", "source").agg(F.max_by("content", "version").alias("content"))
    return every.join(found, ["term", "source"], "left").select("term", "source", F.coalesce("content", F.lit("")).alias("content"))


def page_records(content: DataFrame) -> DataFrame:
    """(term, source, page_no, page: variant) of the records of each content."""
    parsed = F.try_variant_get(F.try_parse_json("content"), "$", "array<variant>")
    return content.select("term", "source", F.posexplode(parsed).alias("page_no", "page"))


def field_items(pages: DataFrame, field: str, pick: str = "$") -> DataFrame:
    """(term, source, page_no, field, item_no, text) of a field's items; ``pick`` is the path inside an item ("$[0]": the first of a pair)."""
    value = F.try_variant_get("page", f"$.{field}", "variant")
    many = F.try_variant_get(value, "$", "array<variant>")
    items = F.when(value.isNotNull(), F.coalesce(many, F.array(value)))
    rows = pages.select("term", "source", "page_no", F.posexplode(items).alias("item_no", "item"))
    return rows.select("term", "source", "page_no", F.lit(field).alias("field"), "item_no", F.try_variant_get("item", pick, "string").alias("text")).filter(F.col("text").isNotNull())


def all_items(pages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Items of several fields (name -> path inside an item)."""
    out = None
    for name, pick in fields.items():
        rows = field_items(pages, name, pick)
        out = rows if out is None else out.unionByName(rows)
    return out


def first_item(items: DataFrame, field: str) -> DataFrame:
    """(term, source, text): the first item of a field on the first page that has it."""
    return items.filter(F.col("field") == field).groupBy("term", "source").agg(F.min_by("text", F.struct("page_no", "item_no")).alias("text"))


def pack_name() -> Column:
    return F.concat_ws(".", "source", "field")


def term_packs(items: DataFrame) -> DataFrame:
    """(term, pack: map of "source.field" to its texts in page and item order)."""
    lists = items.groupBy("term", pack_name().alias("name")).agg(F.sort_array(F.collect_list(F.struct("page_no", "item_no", "text"))).alias("rows"))
    entry = F.struct("name", F.transform("rows", lambda r: r["text"]).alias("texts"))
    return lists.groupBy("term").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("pack"))


def pair_items(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """J4, long: (w1, w2, side, source, page_no, field, item_no, text): every item of both terms of each pair."""
    keys = pairs.select("w1", "w2").distinct()
    sides = keys.select("w1", "w2", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("w1").alias("term")), F.struct(F.lit(2).alias("side"), F.col("w2").alias("term")))).alias("s"))
    return sides.select("w1", "w2", "s.side", "s.term").join(items, "term").drop("term")


def pair_packs(pairs: DataFrame, packs: DataFrame) -> DataFrame:
    """``pairs`` with the packs of both terms (empty map if none)."""
    none = F.create_map().cast("map<string,array<string>>")
    out = pairs
    for n in (1, 2):
        out = out.join(packs.select(F.col("term").alias(f"w{n}"), F.col("pack").alias(f"pack{n}")), f"w{n}", "left")
    return out.select(*pairs.columns, *[F.coalesce(f"pack{n}", none).alias(f"pack{n}") for n in (1, 2)])
