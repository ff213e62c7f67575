"""The corpus pipeline: stages over the documents table, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``, whatever their names and however many
there are. Texts of any length are read whole, and an empty table stays empty."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard, mixing, pieces, quality
from tessera.llm.common import checked_broadcast, materialise, text_or_empty


def _hidden(docs: DataFrame, *used: str) -> DataFrame:
    """The whole row as one struct column beside the columns that an operator reads: no column of docs can clash with the operator's."""
    row = F.struct(F.lit(0).alias("_"), *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return docs.select(row.alias("_row"), *used)


def _shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the documents at hand.

    Null and empty texts are scored as empty ones; repeated rows are kept or rejected alike; with no labels all stay."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _shown(quality.score_documents(_hidden(docs, "text"), model).filter("predicted = 1"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the largest id, of each group of equal texts; null texts are empty texts. Of rows that repeat an id as well one stays."""
    return _shown(exact_dedup.mark_duplicates(_hidden(docs, "doc_id", "text"), carry=["_row"]).filter("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of similar texts (5-word shingles, similarity 0.8).

    Texts without words are similar to nothing. Rows are dropped by id and text, as ids may be null, or shared by different texts."""
    gone = materialise(jaccard.later_copies(docs).withColumnRenamed("doc_id", "_gone_id"), "near_copies")
    rows = _hidden(docs, "doc_id", "text")
    same = rows["doc_id"].cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text_or_empty(rows["text"])) == F.col("text_hash"))
    return _shown(rows.join(checked_broadcast(gone), same, "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source mixing: a document appears as often as the mix takes it, three times at most. Texts without words are not taken."""
    mixed = mixing.mix_sources(_hidden(docs, "doc_id", "text", "source"), carry=["_row"]).filter(F.col("copies") > 0)
    copies = mixed.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return _shown(copies, docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, as piece ids; copies of a document get equal ones, an empty text one without pieces."""
    out = pieces.encode_samples(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id", "lang", "source"],
                                keep=1 << 19)  # workers of earlier stages are still there: a small store
    return out.select("doc_id", "lang", "source", "samples")


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_duplicates", drop_near_copies), ("mixing", mix_sources),
          ("pieces", sample_pieces)]

# Learned scores and sampled segmentations have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
