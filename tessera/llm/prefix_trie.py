"""Prefix trie of conversations: one row for each distinct sequence of first turns.

A turn is known by the first 128 bits of the SHA-256 of its role and text, so texts are read once and
never shuffled. Each conversation becomes one row: its turn ids one after the other (the sort key), the
code points of its turns, its id. Rows are dealt to tasks by ranges of (sequence, id); a group of equal
conversations of any size spreads over as many tasks as its rows need.

A task numbers its turn ids in their order and lays them out as matrices of ``COLUMNS`` turns, padded
below every number; longer conversations go on in further matrices that hold only the rows that reach
them. ``numpy.lexsort`` orders the rows, and an OR accumulated along the columns of "differs from the row
above" marks where nodes start; ``reduceat`` over those starts gives every depth's counts, smallest
ids and sums, from the deepest column up.

A node that holds neither the first nor the last row of its task is whole there, and so is its subtree.
The others lie on the paths of those two rows, at most twice the longest conversation for each task; their
parts are added up by Spark under a digest of the sequence. In their subtrees, whole nodes are summed by
the tasks; nodes that meet other tasks are summed along the paths, each on one path that owns it. The ids
that end at such a node come as text pieces in the tasks' order and are hashed as a stream.

Defined results: rows without a conversation id are left out; null turns come first, rows of equal turn
numbers are ordered by their turn id; repeated rows are turns of their own; an empty table gives no node,
not even a root. Turns of any length are read whole. One conversation is one row of 16 + 4 bytes a turn,
built by one task. Columns of other names are not read."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialise

COLUMNS = 32  # turns of one matrix
SHARD = 400_000  # turns of one task, about
PIECE = 50_000  # conversation ids in one piece of text
NODE, PART, IDS = 0, 1, 2
SCHEMA = ("kind int, key binary, parent_key binary, shard int, side int, depth long, conv long, parent_conv long, "
          "n long, kids long, leaves long, saved long, size long, data binary")
FIELDS = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("shard", pa.int32()), ("side", pa.int32()),
                    *((c, pa.int64()) for c in ("depth", "conv", "parent_conv", "n", "kids", "leaves", "saved", "size")), ("data", pa.binary())])


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv, turns: array of (turn, id, size) in order) of a table (conv_id, turn, role, text)."""
    role, text = F.coalesce(turns["role"], F.lit("")), F.coalesce(turns["text"], F.lit(""))
    turn = F.struct(turns["turn"].alias("turn"), F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32).alias("id"),
                    F.length(text).alias("size"))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv"), turn.alias("t")).filter("conv IS NOT NULL")
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """The first h turns of the conversation of the same hundred, then the own turns after the first h."""
    heads = lists.filter(F.col("conv") % 100 == 0).select(F.col("conv").alias("_first"), F.slice("turns", 1, 5).alias("_head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    kind = lists.schema["turns"].dataType
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(F.array().cast(kind))
    head = F.slice(F.coalesce("_head", F.array().cast(kind)), 1, h)
    joined = lists.join(heads, F.col("conv") - F.col("conv") % 100 == F.col("_first"), "left")
    return joined.select("conv", F.concat(head, own).alias("turns"))


def _chain(ids: np.ndarray) -> list[bytes]:
    """Digests of all prefixes of one row's turn ids (n x 2), the empty one first."""
    out, last = [b""], b""
    for one in ids:
        last = hashlib.sha256(last + one.tobytes()).digest()[:16]
        out.append(last)
    return out


class Matrices:
    """Sorted, padded matrices of one task's conversations: per block the rows that it holds, where nodes start, and which cells are turns."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, conv: np.ndarray):
        begin = np.cumsum(lengths) - lengths
        by_id = np.lexsort((ids[:, 1], ids[:, 0]))
        new = np.any(ids[by_id][1:] != ids[by_id][:-1], axis=1)
        number = np.empty(len(ids), np.int64)
        number[by_id] = np.cumsum(np.r_[False, new]) if len(ids) else 0
        self.order = np.argsort(conv, kind="stable")
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        slots, group = np.arange(len(conv)), np.zeros(len(conv), np.int64)
        while True:
            rows, low = self.order[slots], len(self.blocks) * COLUMNS
            width = min(COLUMNS, int(lengths[rows].max(initial=0)) - low)
            if width <= 0:
                break
            depth = low + np.arange(width)
            turn = depth[None, :] < lengths[rows][:, None]
            cells = np.full(turn.shape, -1, np.int64)
            cells[turn] = number[(begin[rows][:, None] + depth[None, :])[turn]]
            sort = np.lexsort((conv[rows], *cells.T[::-1], group))
            self.order[slots] = rows[sort]
            cells, turn, group = cells[sort], turn[sort], group[sort]
            starts = np.ones(cells.shape, bool)
            starts[1:] = cells[1:] != cells[:-1]
            starts[1:, 0] |= group[1:] != group[:-1]
            np.logical_or.accumulate(starts, axis=1, out=starts)
            self.blocks.append((slots, starts, turn))
            on = turn[:, -1] if width == COLUMNS else np.zeros(len(slots), bool)
            slots, group = slots[on], np.cumsum(starts[:, -1])[on]
        self.depth = int(lengths.max(initial=0))

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the nodes of a depth: rows that reach its matrix, index of the first row and number of rows of each node."""
        slots, starts, turn = self.blocks[(depth - 1) // COLUMNS]
        column = (depth - 1) % COLUMNS
        heads = np.flatnonzero(starts[:, column])
        counts = np.diff(np.r_[heads, len(slots)])
        real = turn[heads, column]
        return slots, heads[real], counts[real]


def _ranges_sum(values: np.ndarray, heads: np.ndarray, counts: np.ndarray, reduce=np.add) -> np.ndarray:
    """Reduction of values[head: head + count] of each range; ranges are ascending and do not overlap."""
    if not len(heads):
        return np.zeros(0, values.dtype)
    if heads[-1] + counts[-1] == len(values):
        edges = np.c_[heads, heads + counts].ravel()[:-1]
    else:
        edges = np.c_[heads, heads + counts].ravel()
    return reduce.reduceat(values, edges)[::2]


def shard_nodes(ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, conv: np.ndarray, shard: int) -> Iterator[dict[str, list]]:
    """Whole nodes, parts of nodes, and ids that end at the latter, of one task's rows, as columns."""
    n = len(conv)
    m = Matrices(ids, lengths, conv)
    begin = (np.cumsum(lengths) - lengths)[m.order]
    conv, length = conv[m.order], lengths[m.order]
    text = [str(c) for c in conv.tolist()]
    paths = [_chain(ids[begin[r]: begin[r] + length[r]]) for r in (0, n - 1)]
    nothing = hashlib.sha256(b"").digest()
    kids, leaves, saved = (np.zeros(n, np.int64) for _ in range(3))  # of the node one level down that starts at a row: 1 if whole, and sums over whole nodes
    child: dict[str, np.ndarray] | None = None
    below = np.zeros(0, np.int64)
    for depth in range(m.depth, -1, -1):
        slots, heads, counts = m.level(depth) if depth else (np.arange(n), np.array([0]), np.array([n]))
        first = slots[heads]
        side = np.where(first == 0, 0, np.where(first + counts == n, 1, -1))
        smallest = _ranges_sum(conv[slots], heads, counts, np.minimum)
        n_kids, n_leaves, n_saved = (_ranges_sum(x[slots], heads, counts) for x in (kids, leaves, saved))
        ends = _ranges_sum((length[slots] == depth).astype(np.int64), heads, counts)
        size = sizes[begin[first] + depth - 1] if depth else np.zeros(1, np.int64)
        if child is not None:  # whole nodes one level down now learn their parents
            up = np.searchsorted(first, child["first"], "right") - 1
            yield {"kind": [NODE] * len(up), "depth": [depth + 1] * len(up), "conv": child["conv"],
                   "parent_conv": [c if s < 0 else None for c, s in zip(smallest[up].tolist(), side[up].tolist(), strict=True)],
                   "parent_key": [None if s < 0 else paths[s][depth] for s in side[up].tolist()],
                   **{c: child[c] for c in ("n", "kids", "leaves", "saved", "data")}}
            child = None
        for x in (kids, leaves, saved):
            x[below] = 0
        below = first
        leaves[first], saved[first] = n_leaves, n_saved
        whole = side < 0
        if whole.any():
            hashes = [hashlib.sha256(",".join(text[f: f + e]).encode()).digest() if e else nothing
                      for f, e in zip(first[whole].tolist(), ends[whole].tolist(), strict=True)]
            child = {"first": first[whole], "conv": smallest[whole], "n": counts[whole], "kids": n_kids[whole],
                     "leaves": n_leaves[whole] + (n_kids[whole] == 0), "saved": n_saved[whole] + (counts[whole] - 1) * size[whole], "data": hashes}
            kids[first[whole]], leaves[first[whole]], saved[first[whole]] = 1, child["leaves"], child["saved"]
        for i in np.flatnonzero(~whole).tolist():
            s, last = int(side[i]), first[i] + counts[i] == n
            key, above = paths[s][depth], paths[s][depth - 1] if depth else None
            both = [s] if s or not last else [0, 1]  # a node of both paths brings its numbers once
            yield {"kind": [PART] * len(both), "key": [key] * len(both), "parent_key": [above] * len(both), "shard": [shard] * len(both), "side": both,
                   "depth": [depth] * len(both), "conv": [smallest[i]] * len(both), "size": [size[i]] * len(both),
                   **{c: [x[i], 0][: len(both)] for c, x in (("n", counts), ("kids", n_kids), ("leaves", n_leaves), ("saved", n_saved))}}
            for lo in range(0, int(ends[i]), PIECE):
                yield {"kind": [IDS], "key": [key], "shard": [shard], "size": [lo],
                       "data": [",".join(text[first[i] + lo: first[i] + min(lo + PIECE, int(ends[i]))]).encode()]}


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, lengths, sizes, conv, shard = [], [], [], [], 0
    for batch in batches:
        if batch.num_rows:
            shard = batch.column(0)[0].as_py()
            conv.append(batch.column(1).to_numpy())
            keys.append(b"".join(batch.column(2).to_pylist()))
            lengths.append(np.diff(batch.column(3).offsets.to_numpy()).astype(np.int64))
            sizes.append(batch.column(3).flatten().to_numpy().astype(np.int64))
    if not conv:
        return
    ids = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)
    held: list[pa.RecordBatch] = []
    for columns in shard_nodes(ids, np.concatenate(lengths), np.concatenate(sizes), np.concatenate(conv), shard):
        n = len(columns["kind"])
        held.append(pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in FIELDS], schema=FIELDS))
        if sum(b.num_rows for b in held) > 20_000 or columns["kind"][0] == IDS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each key; pieces come in order, one is held at a time."""
    key, state = None, None
    for batch in batches:
        done: list[tuple[bytes, bytes]] = []
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k != key:
                if state is not None:
                    done.append((key, state.digest()))
                key, state = k, hashlib.sha256(piece.as_py())
            else:
                state.update(b",")
                state.update(piece.as_py())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.binary()) for i in (0, 1)], ["_ended", "_hash"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.digest()], pa.binary())], ["_ended", "_hash"])


def _recombined(found: DataFrame) -> DataFrame:
    """The nodes that several tasks may hold, whole again."""
    parts = found.filter(F.col("kind") == PART)
    sums = parts.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.max("size").alias("size"),
                                    F.min(F.struct("shard", "side")).alias("owner"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")])
    sums = materialise(sums, "shared_nodes")
    under = sums.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("_up")).agg(F.count(F.lit(1)).alias("_more"))
    full = sums.join(under, F.col("key") == F.col("_up"), "left").withColumn("n_children", F.col("kids") + F.coalesce("_more", F.lit(0)))
    full = full.withColumn("own_leaf", (F.col("n_children") == 0).cast("long")).withColumn("own_saved", (F.col("n") - 1) * F.col("size"))
    full = materialise(full.drop("_up", "_more"), "shared_nodes")
    path = parts.select("key", F.struct("shard", "side").alias("path"), "depth").join(full.select("key", "owner", "own_leaf", "own_saved"), "key")
    below = Window.partitionBy("path").orderBy(F.desc("depth"))
    mine = F.col("path") == F.col("owner")
    sub = path.select("key", F.sum(F.when(mine, F.col("own_leaf")).otherwise(0)).over(below).alias("l"), F.sum(F.when(mine, F.col("own_saved")).otherwise(0)).over(below).alias("s"))
    sub = sub.groupBy(F.col("key").alias("_key")).agg(F.sum("l").alias("_l"), F.sum("s").alias("_s"))
    pieces = found.filter(F.col("kind") == IDS).select("key", "data", "shard", "size").repartition("key").sortWithinPartitions("key", "shard", "size")
    hashes = pieces.select("key", "data").mapInArrow(_hash_ids, "_ended binary, _hash binary")
    above = sums.select(F.col("key").alias("_above"), F.col("conv").alias("parent_conv"))
    return (full.join(sub, F.col("key") == F.col("_key")).join(hashes, F.col("key") == F.col("_ended"), "left").join(above, F.col("parent_key") == F.col("_above"), "left")
            .select("key", "conv", "depth", "parent_conv", "n", "n_children", (F.col("leaves") + F.col("_l")).alias("leaves"), (F.col("saved") + F.col("_s")).alias("saved"),
                    F.coalesce("_hash", F.unhex(F.sha2(F.lit(""), 256))).alias("data")))


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv, turns (array of id, size; ids of 32 hex digits)."""
    rows = conversations.select("conv", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = materialise(rows, "sequences")
    spark = rows.sparkSession
    turns = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    dealt = rows.repartitionByRange(max(-(-turns // SHARD), spark.sparkContext.defaultParallelism), "key", "conv")
    found = materialise(dealt.select(F.spark_partition_id().alias("shard"), "conv", "key", "sizes").mapInArrow(_nodes, SCHEMA), "nodes")
    shared = materialise(_recombined(found), "shared_nodes")
    whole = found.filter(F.col("kind") == NODE)
    known = shared.select(F.col("key").alias("_above"), F.col("conv").alias("_parent"))
    whole = whole.join(checked_broadcast(known), F.col("parent_key") == F.col("_above"), "left")
    both = whole.select("conv", "depth", F.coalesce("parent_conv", "_parent").alias("parent_conv"), "n", F.col("kids").alias("n_children"), "leaves", "saved", "data").unionByName(shared.drop("key"))
    return both.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
                       F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lower(F.hex("data")).alias("ends_sha256"))


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie_nodes(rebuilt(materialise(turn_lists(turns), "turns")))
