"""Approximate nearest neighbours by cross-polytope hashing.

A vector, scaled to unit length, is turned by a fast pseudo-rotation (three
rounds of random signs and a Hadamard transform) and hashed to the signed axis
nearest to it; ``hashes`` such axes make the key of one of ``tables`` tables.
Queries probe each table at their ``probes`` best keys. A cell (table, key) is
split by ``salt`` so that it holds about ``CELL`` vectors at any table size,
and a query visits all splits of a cell. Cells are processed as streams of
sorted rows: the vectors of a cell, then its queries, which are ranked exactly
(Euclidean distance of the original vectors in double precision). Each cell
gives a query its best k + 1; the union over cells is reranked.

Equal vectors form one class that is hashed once and carries its k + 1
smallest ids, so a vector shared by a third of all rows costs one entry.
A query that finds fewer than k candidates in its cells is compared with all
vectors, in blocks of ``BLOCK`` queries.

Nothing is fitted: rotations come from ``seed``, every row is indexed.

Defined results: null, zero-length, zero or non-finite vectors, vectors with a
null component, vectors of another dimension than the commonest (the larger at
a tie) and rows without id take no part; ids that repeat with the same vector
count once, of an id's different vectors the one with the smallest bytes counts; ids are
whole numbers; a query never finds its own id; ties go to the smaller id; an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TABLES, HASHES, PROBES, SEED = 16, 1, 5, 11
CELL = 2048  # vectors of a cell split
SALTS = 16  # parts of a class while its smallest ids are looked for
BLOCK = 512  # queries compared with all vectors at once


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of x (length a power of two) times the orthonormal Hadamard matrix."""
    rows, n = x.shape
    h = 1
    while h < n:
        x = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


def rotations(dim: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    """Random signs [tables, hashes, 3, padded dimension]."""
    width = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, hashes, 3, width))


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Unit vectors of x after one pseudo-rotation."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay in range
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = np.zeros((len(x), signs.shape[1]))
    y[:, :x.shape[1]] = unit
    for s in signs:
        y = hadamard(y * s)
    return y


def keys(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Key of each row of x in each table: the nearest signed axes, [rows, tables]."""
    out = np.zeros((len(x), len(signs)), dtype=np.int64)
    for t, table in enumerate(signs):
        for s in table:
            y = turned(x, s)
            axis = np.abs(y).argmax(1)
            out[:, t] = out[:, t] * (2 * s.shape[1]) + 2 * axis + (y[np.arange(len(y)), axis] > 0)
    return out


def probe_keys(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """The best keys of each row in each table, [rows, tables, probes]: sums of the projections on the axes, largest first."""
    out = []
    for table in signs:
        best = np.zeros((len(x), 1), dtype=np.int64)
        value = np.zeros((len(x), 1))
        for s in table:
            y = turned(x, s)
            signed = np.stack([-y, y], axis=2).reshape(len(y), -1)
            top = np.argsort(-signed, axis=1, kind="stable")[:, :probes]
            total = (value[:, :, None] + np.take_along_axis(signed, top, 1)[:, None, :]).reshape(len(x), -1)
            code = (best[:, :, None] * signed.shape[1] + top[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(-total, axis=1, kind="stable")[:, :probes]
            best, value = np.take_along_axis(code, keep, 1), np.take_along_axis(total, keep, 1)
        out.append(best)
    return np.stack(out, axis=1)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)


def usable(vector: Column) -> Column:
    """Non-null, non-empty, all components present and finite, not all zero."""
    d = vector.cast("array<double>")
    bad = F.exists(d, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(d) > 0) & ~bad & F.exists(d, lambda v: v != 0), F.lit(False))


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors as bytes, in the precision of the table."""
        for batch in batches:
            packed = [np.asarray(v, dtype=kind).tobytes() for v in batch.column("_v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(packed, pa.binary())], ["_id", "_v"])
    return run


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """One row for each different vector: _class (smallest id), _ids (its k + 1 smallest ids), _v."""
    keyed = rows.withColumn("_key", F.sha2("_v", 256)).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    part = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_salt").orderBy("_id"))).filter(F.col("_n") <= k + 1)
    best = part.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_id"))).filter(F.col("_n") <= k + 1)
    # At most k + 1 rows of a class are left.
    return best.groupBy("_key").agg(F.min("_id").alias("_class"), F.sort_array(F.collect_list("_id")).alias("_ids"), F.first("_v").alias("_v")).drop("_key")


CELL_SCHEMA = "_cell long, _query boolean, _id long, _v binary"
FOUND_SCHEMA = "query_id long, _class long, score double"


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of doubles, of differences scaled by their largest component."""
    with np.errstate(over="ignore"):
        d = vectors - query
        squares = np.einsum("ij,ij->i", d, d)
    odd = np.flatnonzero(~np.isfinite(squares) | (squares < 1e-290))
    score = np.sqrt(squares)
    if len(odd):
        largest = np.abs(d[odd]).max(axis=1, keepdims=True)
        scale = np.where((largest > 0) & np.isfinite(largest), largest, 1.0)
        small = d[odd] / scale
        with np.errstate(over="ignore"):
            score[odd] = np.sqrt(np.einsum("ij,ij->i", small, small)) * scale[:, 0]
    return score


def _ranked(ids: np.ndarray, vectors: np.ndarray, queries: list[tuple[int, bytes]], k: int, kind: str) -> Iterator[tuple]:
    """The best k + 1 classes of each query among some vectors."""
    for q, raw in queries:
        score = distances(vectors, np.frombuffer(raw, dtype=kind).astype(np.float64))
        if len(score) > k + 1:
            some = np.flatnonzero(score <= np.partition(score, k)[k])
        else:
            some = np.arange(len(score))
        order = some[np.lexsort((ids[some], score[some]))][:k + 1]
        yield from ((q, int(ids[i]), float(score[i])) for i in order)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    q, c, s = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], ["query_id", "_class", "score"])


def _cells(k: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell, vectors before queries."""
        cell, ids, raw, matrix = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            for c, is_query, i, v in zip(*(batch.column(n).to_pylist() for n in ("_cell", "_query", "_id", "_v")), strict=True):
                if c != cell:
                    cell, ids, raw, matrix = c, [], [], None
                if not is_query:
                    ids.append(i)
                    raw.append(v)
                elif len(ids):
                    if matrix is None:
                        matrix = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(ids), -1).astype(np.float64)
                        ids, raw = np.array(ids), []
                    out += _ranked(ids, matrix, [(i, v)], k, kind)
            if out:
                yield _batch(out)
    return run


def nearest(vectors: DataFrame, queries: Column, vector: str = "embedding", key: str = "vec_id", k: int = 10, tables: int = TABLES,
            hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """For each row that ``queries`` selects its k nearest other rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    valid = vectors.filter(vectors[key].isNotNull() & usable(vectors[vector])).select(
        vectors[key].cast("long").alias("_id"), vectors[vector].cast("array<double>").alias("_v"), queries.alias("_asked"))
    commonest = valid.groupBy(F.size("_v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if commonest is None:
        return empty
    dim = commonest["dim"]
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    valid = valid.filter(F.size("_v") == dim)
    # One vector for each id.
    packed = materialise(valid.select("_id", "_v").mapInArrow(_packed(kind), "_id long, _v binary").groupBy("_id").agg(F.min("_v").alias("_v")), "vectors")
    classes = materialise(classes_of(packed, k), "classes")
    asked = materialise(packed.join(valid.filter("_asked").select("_id").distinct(), "_id", "left_semi"), "queries")
    signs = rotations(dim, tables, hashes, seed)
    width = (2 * signs.shape[-1]) ** hashes
    n_classes = classes.count()
    splits = max(1, -(-n_classes // (width * CELL)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_v"), kind)
            code = keys(x, signs) if len(x) else np.zeros((0, tables), dtype=np.int64)
            salt = np.array(batch.column("_id").to_pylist(), dtype=np.int64) % splits
            for t in range(tables):
                cell = (t * width + code[:, t]) * splits + salt
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.zeros(len(x), dtype=bool)), batch.column("_id"), batch.column("_v")],
                                                 ["_cell", "_query", "_id", "_v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_v"), kind)
            code = probe_keys(x, signs, probes) if len(x) else np.zeros((0, tables, probes), dtype=np.int64)
            for t in range(tables):
                for p in range(code.shape[2]):
                    for s in range(splits):
                        cell = (t * width + code[:, t, p]) * splits + s
                        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.ones(len(x), dtype=bool)), batch.column("_id"), batch.column("_v")],
                                                         ["_cell", "_query", "_id", "_v"])

    placed = classes.select(F.col("_class").alias("_id"), "_v").mapInArrow(place, CELL_SCHEMA)
    probed = asked.mapInArrow(probe, CELL_SCHEMA)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = placed.unionByName(probed).repartition(n_parts, "_cell").sortWithinPartitions("_cell", "_query")
    found = materialise(cells.mapInArrow(_cells(k, kind), FOUND_SCHEMA), "found")
    ranked = _rerank(found, classes, k)
    # Queries with too few candidates are compared with every vector.
    fewer = min(k, n_classes - 1)
    enough = found.groupBy("query_id").agg(F.countDistinct("_class").alias("n")).filter(F.col("n") > fewer)
    short = materialise(asked.join(enough.select(F.col("query_id").alias("_id")), "_id", "left_anti"), "short")
    n_short = short.count()
    if n_short:
        ranked = ranked.join(short.select(F.col("_id").alias("query_id")).distinct(), "query_id", "left_anti")
        ranked = ranked.unionByName(_rerank(_exhaustive(classes, short, n_short, k, kind), classes, k))
    return ranked


def _exhaustive(classes: DataFrame, short: DataFrame, n_short: int, k: int, kind: str) -> DataFrame:
    """All vectors against the queries of ``short``, in blocks that a task can hold; no pair is emitted beyond each part's best."""
    blocks = -(-n_short // BLOCK)
    found = None
    for b in range(blocks):
        some = [(r["_id"], bytes(r["_v"])) for r in short.filter(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b).collect()]

        def compare(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch) and some:
                    rows = list(_ranked(np.array(batch.column("_id").to_pylist()), _matrix(batch.column("_v"), kind), some, k, kind))
                    yield _batch(rows)

        part = materialise(classes.select(F.col("_class").alias("_id"), "_v").mapInArrow(compare, FOUND_SCHEMA), "exhaustive")
        found = part if found is None else found.unionByName(part)
    return found


def _rerank(found: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Classes found for each query to its k nearest rows."""
    best = found.groupBy("query_id", "_class").agg(F.min("score").alias("score"))
    top = best.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "_class"))).filter(F.col("_n") <= k + 1)
    rows = top.join(classes.select("_class", "_ids"), "_class").select("query_id", "score", F.explode("_ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (rows.filter(F.col("vec_id") != F.col("query_id")).withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
