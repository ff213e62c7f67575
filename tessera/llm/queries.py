"""Registered queries of the corpus operators: thin adapters that derive the digest columns."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, html_text, jaccard, licenses, mixing, oracles, pieces, pii, prefix_trie, quality, resample, secrets, spans, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op2_mix_sources", oracles.MIX)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@register("op10_exact_dedup", oracles.EXACT_DEDUP)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), carry=["doc_id"])


@register("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"])


@register("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register("op1_secrets", oracles.secret_scan())
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secrets.counted(F.col("base_secrets"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, spans.digest(F.col("base_secrets")).alias("base_sha256"),
                        spans.joined(F.col("secrets")).alias("spans"))


@register("op5_private", oracles.private_data(pii.SUPPORT, pii.REMOVE, pii.GENERALISE))
def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(table(spark, sf_dir, "documents"), carry=["doc_id"])
    counts = [secrets.counted(F.col("base_private"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, spans.digest(F.col("base_private")).alias("base_sha256"),
                        spans.joined(F.col("private")).alias("spans"))


@register("op5_disclosing_words", oracles.disclosing_words(pii.SUPPORT, pii.REMOVE, pii.GENERALISE))
def op5_disclosing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each word that discloses a kind or a value, on any line of the documents that hold it."""
    return pii.disclosing_words(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op5_sanitised")
def op5_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold personal data, with their sanitised text."""
    found = pii.find_private(table(spark, sf_dir, "documents"), carry=["doc_id", "text"])
    held = found.filter(F.size("private") > 0)
    return pii.sanitise(held).select("doc_id", F.size("private").cast("long").alias("n_spans"), "sanitised")


@register("op7_nearest")
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 100 == 0)


@register("op9_ngram_join", oracles.ngram_join(4, 85))
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)


@register("op9_ngram_links")
def op9_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each similar pair of different n-gram sets."""
    return jaccard.similar_sets(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)


@register("op9_link_counts")
def op9_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)


@register("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_text(pages, html_text.train_labeller(pages))


@register("op4_sample_pieces")
def op4_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and sample, by falling perturbed score: the piece ids, and whether they decode to the text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode_samples(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"], check=True)
    one = out.select("doc_id", F.posexplode("samples").alias("sample", "s"))
    return one.select("doc_id", "sample", F.size("s.ids").cast("long").alias("n_pieces"), F.xxhash64("s.ids").alias("ids_hash"),
                      "s.log_prob", "s.perturbed", "s.log_inclusion", "s.ids", "s.decoded_sha256", "s.round_trip")


@register("op12_resample", oracles.RESAMPLE)
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@register("op13_prefix_trie", oracles.PREFIX_TRIE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@register("op11_licenses", oracles.license_scan())
def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = F.col("base_places")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["start"]).alias("first_word"),
                        F.array_max(base["start"]).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base["label"])), ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")
