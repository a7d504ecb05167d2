"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups, largest first, enter the bin with the least remaining capacity that holds them, found in a balanced tree. Packing
has two levels, so that no task and no driver sees every group: tasks pack groups into blocks of a BLOCKS-th of a shard;
the driver packs the blocks into shards. At most one block a task is half full or less, so the driver has no more than
2 * BLOCKS * shards blocks and one a task. With a number of shards given, the driver looks for the least capacity that
packs into so many, which makes their sizes near equal.

Groups larger than a block (no more than BLOCKS * shards can be) are dealt out in pieces; these stay in one shard unless
the group is larger than a fair shard, which nothing indivisible can even out. Then its pieces are packed on their own.

With a fixed capacity, shards are as many as it takes: tasks pack whole groups into shards, and the driver sees one row a
task, its emptiest shard, and packs those together. Groups beyond the capacity are dealt out and packed by their rows.

Sizes are UTF-8 bytes and ``overhead``; a null text has none, and the checksum of an empty one. Long texts are rows like
others, of any size; one beyond a fixed capacity has a shard of its own. Null ids and repeated rows are rows like others.
An empty table gives no rows. Other columns are not read. A task holds about ROWS_A_TASK rows of three numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BLOCKS = 64
OVERHEAD = 8
ROWS_A_TASK = 1_000_000


class _Tree:
    """A balanced search tree (AA tree) of (remaining capacity, bin)."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # [key, level, left, right]

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[3][3][1] == t[1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def add(self, key) -> None:
        self.root = self._add(self.root, key)

    def _add(self, t, key):
        if t is None:
            return [key, 1, None, None]
        side = 2 if key < t[0] else 3
        t[side] = self._add(t[side], key)
        return self._split(self._skew(t))

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, t, key):
        if t is None:
            return None
        if key == t[0]:
            if t[2] is None and t[3] is None:
                return None
            if t[2] is None:
                near = t[3]
                while near[2]:
                    near = near[2]
                t[0] = near[0]
                t[3] = self._remove(t[3], near[0])
            else:
                near = t[2]
                while near[3]:
                    near = near[3]
                t[0] = near[0]
                t[2] = self._remove(t[2], near[0])
        else:
            side = 2 if key < t[0] else 3
            t[side] = self._remove(t[side], key)
        least = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
        if least < t[1]:
            t[1] = least
            if t[3] and t[3][1] > least:
                t[3][1] = least
        t = self._skew(t)
        t[3] = self._skew(t[3])
        if t[3]:
            t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        t[3] = self._split(t[3])
        return t

    def tightest(self, size: int):
        """The least key whose remaining capacity is ``size`` or more."""
        t, best = self.root, None
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def best_fit_decreasing(sizes, capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each size. A size beyond the capacity has a bin of its own. None if more than ``bins`` are needed."""
    tree, out, n = _Tree(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        key = tree.tightest(size)
        if key is None:
            if n == bins:
                return None
            remaining, own = max(capacity - size, 0), n
            n += 1
        else:
            tree.remove(key)
            remaining, own = key[0] - size, key[1]
        tree.add((remaining, own))
        out[i] = own
    return out


def pack_into(sizes: list[int], bins: int) -> list[int]:
    """Best fit decreasing with about the least capacity that takes no more than ``bins``."""
    low, high = max(-(-sum(sizes) // bins), max(sizes, default=1), 1), 2 * max(-(-sum(sizes) // bins), max(sizes, default=1), 1)
    best = best_fit_decreasing(sizes, high, bins)
    while best is None:
        high *= 2
        best = best_fit_decreasing(sizes, high, bins)
    while high - low > max(1, low // 20_000):
        mid = (low + high) // 2
        if (got := best_fit_decreasing(sizes, mid, bins)) is None:
            low = mid
        else:
            best, high = got, mid
    return best


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, group (equal texts), written once: all that follows reads these narrow rows."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    cols = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group")]
    return written(docs.select(*cols).withColumn("row", F.monotonically_increasing_id()), "sized")


def pack(rows: DataFrame, shards: int | None = 24, capacity: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Rows of size, group and a unique row, with ``shard`` and ``slot`` (from 0 without gaps in each shard).

    Either into ``shards`` shards of near equal sizes, or into as few as fit of ``capacity``.
    """
    spark = rows.sparkSession
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_A_TASK))
    if capacity:
        return _pack_fixed(rows, capacity, parts)
    fair = max(1, -(-total // shards))
    unit = max(1, fair // blocks)
    sums = rows.groupBy("group").agg(F.sum("size").alias("group_size")).where(F.col("group_size") > unit)
    # fewer than total / unit: at most blocks * shards rows and a few, whatever the input
    big = F.broadcast(sums.withColumn("pieces", F.ceil(F.col("group_size") / unit).cast("int")))
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("row"), F.col("pieces")))
    dealt = rows.join(big, "group", "left").withColumn("piece", piece).select("row", "group", "size", "piece", "group_size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), SCHEMA)
        if not t.num_rows:
            return
        row, group, size, piece, group_size = (t[c].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False) for c in SCHEMA.names)
        order = np.lexsort((row, piece, group))
        group, size, piece, row, group_size = group[order], size[order], piece[order], row[order], group_size[order]
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (piece[1:] != piece[:-1])))
        n = np.diff(np.append(first, len(row)))
        sums, whole = np.add.reduceat(size, first), piece[first] < 0
        block = np.zeros(len(first), np.int64)
        block[whole] = best_fit_decreasing(sums[whole].tolist(), unit)
        block[~whole] = (block[whole].max() + 1 if whole.any() else 0) + np.arange((~whole).sum())
        by_unit = np.argsort(block, kind="stable")
        rows_of = np.repeat(first[by_unit], n[by_unit]) + np.arange(len(row)) - np.repeat(np.cumsum(n[by_unit]) - n[by_unit], n[by_unit])
        own = np.repeat(block[by_unit], n[by_unit])
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        at = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        task = TaskContext.get().partitionId()
        bundle = np.where((piece[rows_of] >= 0) & (group_size[rows_of] <= fair), group[rows_of], 0)
        together = (piece[rows_of] >= 0) & (group_size[rows_of] <= fair)
        cols = [pa.array(row[rows_of]), pa.array(size[rows_of]), pa.array(np.full(len(own), task, np.int32)), pa.array(own.astype(np.int32)), pa.array(at), pa.array(bundle, mask=~together)]
        yield from pa.table(cols, names=["row", "size", "task", "block", "at", "bundle"]).to_batches(max_chunksize=50_000)

    packed = written(dealt.repartition(parts, "group", "piece").mapInArrow(run, "row long, size long, task int, block int, at long, bundle long"), "packed")
    found = packed.groupBy("task", "block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("bundle").alias("bundle")).collect()
    items: dict[object, list] = {}
    for b in sorted(found, key=lambda b: (b.task, b.block)):
        items.setdefault(("group", b.bundle) if b.bundle is not None else (b.task, b.block), []).append(b)
    sizes = [sum(b["size"] for b in own) for own in items.values()]
    shard = pack_into(sizes, shards)
    base: dict[int, int] = {}
    places = []
    for own, k in zip(items.values(), shard, strict=True):
        for b in own:
            places.append((b.task, b.block, k, base.get(k, 0)))
            base[k] = base.get(k, 0) + b.n
    placed = F.broadcast(spark.createDataFrame(places, "task int, block int, shard int, base long"))
    slots = packed.join(placed, ["task", "block"]).select("row", "shard", (F.col("base") + F.col("at")).alias("slot"))
    return rows.join(slots, "row")


def _pack_fixed(rows: DataFrame, capacity: int, parts: int) -> DataFrame:
    """Rows with ``shard`` and ``slot``, in shards of no more than the capacity (or of one row beyond it)."""
    sums = rows.groupBy("group").agg(F.sum("size").alias("group_size")).where(F.col("group_size") > capacity)
    large = F.col("group_size").isNotNull()
    # two pieces a shard that the group fills, so that a piece goes to one task and is packed there by its rows
    piece = F.when(large, F.pmod(F.xxhash64("row"), F.ceil(2 * F.col("group_size") / capacity))).otherwise(0)
    dealt = rows.join(sums, "group", "left").select("row", F.when(large, F.col("row")).otherwise(F.col("group")).alias("item"), "size", large.cast("long").alias("large"), "group", piece.cast("long").alias("piece"))
    names = ["row", "item", "size", "large"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]) for b in batches if b.num_rows]
        if not own:
            return
        row, item, size, large = np.concatenate(own, axis=1)
        order = np.lexsort((row, item, large))
        row, item, size, large = row[order], item[order], size[order], large[order]
        first = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (large[1:] != large[:-1])))
        own = np.repeat(np.array(best_fit_decreasing(np.add.reduceat(size, first).tolist(), capacity)), np.diff(np.append(first, len(row))))
        by_bin = np.argsort(own, kind="stable")
        own = own[by_bin]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        at = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        task = np.full(len(own), TaskContext.get().partitionId(), np.int32)
        yield from pa.table([pa.array(row[by_bin]), pa.array(size[by_bin]), pa.array(task), pa.array(own), pa.array(at)], names=["row", "size", "task", "bin", "at"]).to_batches(max_chunksize=50_000)

    packed = written(dealt.repartition(parts, "group", "piece").mapInArrow(run, "row long, size long, task int, bin long, at long"), "packed")
    bins = packed.groupBy("task", "bin").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    tasks = sorted(bins.groupBy("task").agg(F.count(F.lit(1)).alias("bins"), F.min(F.struct("size", "bin", "n")).alias("last")).collect(), key=lambda r: r.task)
    shard, base, places, taken = best_fit_decreasing([r.last["size"] for r in tasks], capacity), 0, [], {}
    whole = sum(r.bins - 1 for r in tasks)
    for r, k in zip(tasks, shard, strict=True):
        places.append((r.task, base, r.last["bin"], whole + k, taken.get(k, 0)))
        base += r.bins - 1
        taken[k] = taken.get(k, 0) + r.last["n"]
    # one row a task
    placed = F.broadcast(rows.sparkSession.createDataFrame(places, "task int, base long, last long, last_shard long, last_base long"))
    is_last = F.col("bin") == F.col("last")
    number = F.when(is_last, F.col("last_shard")).otherwise(F.col("base") + F.col("bin") - (F.col("bin") > F.col("last")).cast("long"))
    slots = packed.join(placed, "task").select("row", number.cast("int").alias("shard"), (F.col("at") + F.when(is_last, F.col("last_base")).otherwise(0)).alias("slot"))
    return rows.join(slots, "row")


SCHEMA = pa.schema([("row", pa.int64()), ("group", pa.int64()), ("size", pa.int64()), ("piece", pa.int64()), ("group_size", pa.int64())])


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(sized(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
