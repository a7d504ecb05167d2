"""Line dedup: a key of a line that is in many documents keeps its lines only in the largest doc_id that holds it.

Key hashes (128 bits) are counted with map-side sums. Those in ``min_docs`` documents or more are indexed by sharded
minimal perfect hashes, built in tasks, with arrays of fingerprints (64 bits), counts and largest ids; documents probe
these arrays. The index is broadcast only up to ``max_index_bytes``; beyond, lines are joined instead, with equal results.

A null or empty text is one empty line. Each row counts as a document, also if its id is repeated. A null id is below all
others; if only rows of null id hold a key, all of them keep it. All other columns come back as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mph
from .common import kept, small_batches, table, written

SPACE = b" \t\n\x0b\x0c\r"
LEAST = -(1 << 63)
#: Keys of a shard, about.
SHARD_KEYS = 1 << 17


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped, A-Z lower-cased; None if it has fewer code points than min_chars."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _digests(parts: list[bytes], min_chars: int) -> tuple[list[int], list[bytes]]:
    where, out = [], []
    for i, x in enumerate(parts):
        if len(x) >= min_chars and (key := line_key(x, min_chars)) is not None:
            where.append(i)
            out.append(xxhash.xxh3_128_digest(key))
    return where, out


def _ids(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(LEAST).to_numpy(zero_copy_only=False)


def _texts(col: pa.Array) -> list[bytes]:
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def line_counts(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """h1, h2, n (documents), last (largest id) of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            keys, n = [], []
            for text in _texts(batch.column(1)):
                got = set(_digests(text.split(b"\n"), min_chars)[1])
                keys.extend(got)
                n.append(len(got))
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.repeat(_ids(batch.column(0)), n))], names=["h1", "h2", "id"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = narrow.mapInArrow(run, "h1 long, h2 long, id long")
    return rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


def build_shard(rows: pa.Table) -> pa.Table:
    h1 = rows["h1"].to_numpy().view(np.uint64)
    h2, n, last = (rows[c].to_numpy() for c in ("h2", "n", "last"))
    own = np.zeros(len(h1), bool)
    own[np.unique(h1, return_index=True)[1]] = True  # of equal h1, which 128 bits tell apart, the others are listed
    f = mph.MinimalPerfectHash.build(h1[own])
    slot = np.argsort(f.slots(h1[own]))
    blob = mph.pack({"print": h2[own][slot], "count": np.minimum(n[own][slot], 2**32 - 1).astype(np.uint32), "last": last[own][slot], "more1": h1[~own], "more2": h2[~own], "more_last": last[~own]}, f)
    return pa.table({"shard": rows["shard"][:1].cast(pa.int32()), "blob": pa.array([blob], pa.binary())})


class LineIndex:
    """Shards by h1 modulo their number."""

    def __init__(self, blobs: list[bytes | None]):
        self.shards = [mph.unpack(x) if x is not None else None for x in blobs]

    def last(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the index, and the largest document of each of them."""
        found, last = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        at = h1 % np.uint64(len(self.shards))
        for k, shard in enumerate(self.shards):
            if shard is None or not len(i := np.flatnonzero(at == k)):
                continue
            f, arrays = shard
            slot = f.slots(h1[i])
            ok = (slot >= 0) & (arrays["print"][slot] == h2[i])
            found[i[ok]], last[i[ok]] = True, arrays["last"][slot[ok]]
            for a, b, c in zip(arrays["more1"], arrays["more2"], arrays["more_last"], strict=True):
                j = i[(h1[i] == a) & (h2[i] == b)]
                found[j], last[j] = True, c
        return found, last


def build_index(common: DataFrame, n_keys: int) -> DataFrame:
    """shard, blob: of about SHARD_KEYS keys each, by tasks."""
    n = shard_count(n_keys)
    unsigned = F.pmod(F.pmod("h1", F.lit(n)) + F.when(F.col("h1") < 0, F.lit((1 << 64) % n)).otherwise(0), F.lit(n)).cast("int")
    return common.withColumn("shard", unsigned).groupBy("shard").applyInArrow(build_shard, "shard int, blob binary")


def shard_count(n_keys: int) -> int:
    return max(1, -(-n_keys // SHARD_KEYS))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, max_index_bytes: int = 128 << 20, counts_to: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents, ``text_col`` without the dropped lines; ``counts_to`` names columns for the lines before and dropped.

    ValueError if such a column is there already.
    """
    if counts_to and set(counts_to) & set(docs.columns):
        raise ValueError(f"{counts_to} clash with columns of the documents")
    spark = docs.sparkSession
    common = written(line_counts(docs, id_col, text_col, min_chars).where(F.col("n") >= min_docs), "lines-common")
    n_keys = common.count()
    # 64-bit prints and ids, 32-bit counts and 3 bits of hash function a key
    if 24 * n_keys <= max_index_bytes:
        blobs: list[bytes | None] = [None] * shard_count(n_keys)
        if n_keys:
            for row in build_index(common, n_keys).toLocalIterator():
                blobs[row.shard] = bytes(row.blob)
        index = spark.sparkContext.broadcast(blobs)
        out, probe, lists, key = docs, True, None, uuid.uuid4().hex
    else:
        index, probe, lists, key = None, False, "__dropped_keys", ""
        out = _joined(docs, common, id_col, text_col, min_chars, lists)
    fields = {f.name: f for f in docs.schema.fields}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.values()) + (f", `{counts_to[0]}` long, `{counts_to[1]}` long" if counts_to else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = kept("lines", key, lambda: LineIndex(index.value)) if probe else None
        for batch in small_batches(batches, text_col):
            names = batch.schema.names
            parts = [x.split(b"\n") for x in _texts(batch.column(names.index(text_col)))]
            keys = [_digests(x, min_chars) for x in parts]
            if probe:
                n = np.array([len(x) for x, _ in keys], np.int64)
                h = np.frombuffer(b"".join(y for _, x in keys for y in x), "<u8").reshape(-1, 2)
                found, last = arrays.last(h[:, 0], h[:, 1].view(np.int64))
                drop = found & (last != np.repeat(_ids(batch.column(names.index(id_col))), n))
            else:
                gone = [{*(x or ())} for x in batch.column(names.index(lists)).to_pylist()]
                drop = np.array([y in g for (_, x), g in zip(keys, gone, strict=True) for y in x], bool)
            texts, dropped, at = [], [], 0
            for p, (where, _) in zip(parts, keys, strict=True):
                flags = drop[at : at + len(where)]
                at += len(where)
                lost = {where[i] for i in np.flatnonzero(flags)} if flags.any() else ()
                dropped.append(len(lost))
                texts.append(b"\n".join([x for i, x in enumerate(p) if i not in lost] if lost else p))
            cols = dict(zip(names, batch.columns, strict=True))
            old = cols[text_col]
            new = pa.array(texts, pa.binary()).cast(pa.string())
            cols[text_col] = pa.compute.if_else(old.is_null(), pa.scalar(None, pa.string()), new) if old.null_count else new
            cols.pop(lists, None)
            if counts_to:
                cols |= {counts_to[0]: pa.array([len(x) for x in parts], pa.int64()), counts_to[1]: pa.array(dropped, pa.int64())}
            yield pa.record_batch(list(cols.values()), names=list(cols))

    return out.mapInArrow(run, schema)


def _joined(docs: DataFrame, common: DataFrame, id_col: str, text_col: str, min_chars: int, lists: str) -> DataFrame:
    """The documents with the keys that each loses, by joins on keys and ids: the way for an index of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            keys = [sorted(set(_digests(x.split(b"\n"), min_chars)[1])) for x in _texts(batch.column(1))]
            h = np.frombuffer(b"".join(y for x in keys for y in x), "<i8").reshape(-1, 2)
            yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([y for x in keys for y in x], pa.binary()), pa.array(np.repeat(_ids(batch.column(0)), [len(x) for x in keys]))], names=["h1", "h2", "key", "id"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lost = narrow.mapInArrow(run, "h1 long, h2 long, key binary, id long").join(common.select("h1", "h2", "last"), ["h1", "h2"]).where("last <> id")
    lost = lost.groupBy("id").agg(F.collect_set("key").alias(lists)).withColumnRenamed("id", "__lost_id")
    return docs.join(lost, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LEAST)) == lost["__lost_id"], "left").drop("__lost_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
