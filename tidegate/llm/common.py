"""What the operators share: places for written tables, and words of whole texts as numpy arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1


# ------------------------------------------------------------------ places


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; on a cluster that is an error, since a folder of one
    machine would lose what the others write.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidegate-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/") if "://" in root else "file://" + os.path.abspath(root)


def shared_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidegate_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more: all that was made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tidegate_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_KEPT: dict[str, tuple[str, object]] = {}


def kept(kind: str, key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this Python worker for the tasks after this one; one of each kind, that of ``key``."""
    if _KEPT.get(kind, ("", None))[0] != key:
        _KEPT.pop(kind, None)
        _KEPT[kind] = key, make()
    return _KEPT[kind][1]


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per context, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_tidegate_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="tidegate-ship-"), "tidegate_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "tidegate")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    sc._tidegate_shipped = True


def schema_of(df: DataFrame, *more: str) -> str:
    """The columns of a DataFrame, and more, as the text that mapInArrow takes."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


# ------------------------------------------------------------------ text as bytes


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the len+1 offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``size`` bytes."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, b
        a = b


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes after lower-casing, of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, a-z, all beyond ASCII).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Word bytes of [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    with np.errstate(over="ignore"):
        done = 1
        while done < n:
            step = U64(pow(base, done, 1 << 64))
            k = min(done, n - done)
            out[done : done + k] = out[:k] * step
            done += k
    return out


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["up"] = _powers(_P, CHUNK)
        _TABLES["down"] = _powers(pow(_P, -1, 1 << 64), CHUNK)
    return _TABLES["up"], _TABLES["down"]


@dataclass
class Words:
    """Words of the rows ``first`` to ``last - 1``: bounds in ``data`` (lower-cased), a 64-bit hash each, words a row."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def find_words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = table[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = m.copy()
    start[1:] &= ~m[:-1] | edge[1:n]
    end = m.copy()
    end[:-1] &= ~m[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials of the bytes modulo 2**64, mixed; blocks bound the memory."""
    up, down = _tables()
    out = np.zeros(len(starts), U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), CHUNK):
            a, b = np.searchsorted(starts, (at, at + CHUNK))
            if a == b:
                continue
            piece = data[at : at + CHUNK]
            sums = np.zeros(len(piece) + 1, U64)
            np.cumsum((piece.astype(U64) + U64(1)) * up[: len(piece)], out=sums[1:])
            s, e = starts[a:b] - at, ends[a:b] - at
            over = e > len(piece)
            out[a:b] = (sums[np.minimum(e, len(piece))] - sums[s]) * down[s]
            for k in np.flatnonzero(over):  # the last word of a block, if it goes on in the next
                total, word = 0, data[starts[a + k] : ends[a + k]]
                for x in range(0, len(word), CHUNK):
                    part = word[x : x + CHUNK].astype(U64) + U64(1)
                    total += int((part * up[: len(part)]).sum(dtype=U64)) * pow(_P, x, 1 << 64)
                out[a + k] = U64(total % (1 << 64))
        return mix(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_chunks(col: pa.Array, table: np.ndarray, hashed: bool = True) -> Iterator[Words]:
    """Words of a string column, A-Z lower-cased, in chunks of whole rows."""
    data, offs = text_buffers(col)
    for a, b in chunks(offs):
        own = LOWER[data[offs[a] : offs[b]]]
        starts, ends, counts = find_words(own, offs[a : b + 1] - offs[a], table)
        yield Words(a, b, own, starts, ends, hash_words(own, starts, ends) if hashed else np.zeros(0, U64), counts)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive word hashes; those that cross rows are the caller's to drop."""
    if len(h) < k:
        return np.zeros(0, U64)
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out *= U64(0x9FB21C651E98DF25)
            out += h[i : i + n]
        return mix(out + U64(k))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for all s, n."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def small_batches(batches: Iterator[pa.RecordBatch], text: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``size`` bytes of text, so that memory and 32-bit offsets hold for long texts."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        for a, b in chunks(offs, size):
            yield batch.slice(a, b - a)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under its own names, so that no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


LEAST = -(1 << 63)
#: Ids that are sent to where the texts are (some 100 bytes each as a hash table); beyond, texts are shuffled to them.
MAX_IDS = 1_000_000


def _keys(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LEAST)), F.xxhash64(text), text


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (LEAST for null), t (a hash of the text) and text, under names of our own: id and t tell texts of one id apart."""
    i, t, text = _keys(id_col, text_col)
    return docs.select(i.alias("id"), t.alias("t"), text.alias("text"))


def matching(docs: DataFrame, ids: DataFrame, how: str, id_col: str, text_col: str, most: int | None = None) -> DataFrame:
    """The documents whose id and t are among ``ids`` (left_semi), or aren't (left_anti), as they are.

    Texts stay where they are while the ids are few enough to be sent to them.
    """
    few = ids.count() <= (MAX_IDS if most is None else most)
    own = (F.broadcast(ids) if few else ids).select(F.col("id").alias("__tidegate_id"), F.col("t").alias("__tidegate_t"))
    i, t, _ = _keys(id_col, text_col)
    return docs.join(own, (i == F.col("__tidegate_id")) & (t == F.col("__tidegate_t")), how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
