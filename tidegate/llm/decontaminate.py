"""Benchmark decontamination by winnowing.

Of every ``span - k + 1`` consecutive k-grams the one of least hash is a fingerprint, of documents as of items; so any span
of ``span`` words that both hold gives them a fingerprint in common, at the same place in the span. Documents' fingerprints
are joined with those of the items: probed in the tasks while these are MAX_PRINTS or fewer, else joined. Each hit is then
extended to the windows of ``span`` words that hold it, and these are joined with the items' windows by 128-bit digests of
their words. Items of fewer words are one window as a whole, with a fingerprint of that length; for each such length (below
``span``, so few), all grams of the documents are looked up.

Only numbers are moved, texts stay where they are: a document gives no more windows than it has words, however often its
words are repeated, and its windows are merged as sets of places. Beyond MAX_PRINTS, the ids of documents with hits are
sent to the texts while they are MAX_IDS or fewer, and texts are shuffled to them only beyond.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Null and empty texts have no words, hits or items; items
without words match nothing. Items of equal id are one item; those of a null id are one item without a name. Rows of
equal doc_id are each judged by their own text. Empty tables give no rows or no hits; other columns are not read, and
``decontaminated`` gives them back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LEAST, MAX_IDS, U64, Words, discard, gram_hashes, id_text, keyed_text, matching, small_batches, table, word_chunks, written

SPAN, K = 13, 5
#: Fingerprints of items that every task gets, at 8 bytes each; beyond, they are joined.
MAX_PRINTS = 1_000_000


def sliding(op, a: np.ndarray, w: int) -> np.ndarray:
    """op over each w consecutive elements."""
    if len(a) < w:
        return a[:0]
    size = 1
    while size * 2 <= w:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


def winnow(hashes: np.ndarray, counts: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of rows of word hashes: their positions over all rows, and the hashes. Ties are all taken."""
    w, g = span - k + 1, gram_hashes(hashes, k)
    low = sliding(np.minimum, g, w)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    ends = np.repeat(np.cumsum(counts), counts)[: len(low)]
    low = np.where(np.arange(len(low)) + span <= ends, low, U64(0))
    pad = np.zeros(w - 1, U64)
    at = np.flatnonzero(sliding(np.maximum, np.concatenate([pad, low, pad]), w) == g)
    return at, g[at]


def _ids(col: pa.Array) -> np.ndarray:
    return col.fill_null(LEAST).to_numpy(zero_copy_only=False)


def _digests(words: list[bytes], starts: list[int], size: int) -> np.ndarray:
    """Two 64-bit numbers for each window of ``size`` words."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(b" ".join(words[s : s + size])) for s in starts]), "<i8").reshape(-1, 2)


def item_prints(items: DataFrame, span: int, k: int) -> DataFrame:
    """h, size (words that must match: span, or all of a short item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for c in word_chunks(batch.column(1), ALNUM):
                h, bounds = winnow(c.hashes, c.counts, span, k)[1], c.bounds
                few = np.flatnonzero((c.counts > 0) & (c.counts < span))
                short = np.array([gram_hashes(c.hashes[a : a + n], n)[0] for a, n in zip(bounds[few].tolist(), c.counts[few].tolist(), strict=True)], U64)
                sizes = np.concatenate([np.full(len(h), span), c.counts[few]]).astype(np.int32)
                yield pa.record_batch([pa.array(np.concatenate([h, short]).view(np.int64)), pa.array(sizes)], names=["h", "size"])

    return items.mapInArrow(run, "h long, size int").distinct()


def item_windows(items: DataFrame, span: int) -> DataFrame:
    """item_id, size, w1, w2 (the digest) of the distinct windows of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            ids = _ids(batch.column(0))
            for c in word_chunks(batch.column(1), ALNUM, hashed=False):
                bounds = c.bounds.tolist()
                for r, n in enumerate(c.counts.tolist()):
                    if not n:
                        continue
                    words = [c.data[s:e].tobytes() for s, e in zip(c.starts[bounds[r] : bounds[r + 1]], c.ends[bounds[r] : bounds[r + 1]], strict=True)]
                    size = min(n, span)
                    w = np.unique(_digests(words, range(n - size + 1), size), axis=0)
                    same = lambda x, t: pa.array(np.full(len(w), x, t))  # noqa: B023, E731
                    yield pa.record_batch([same(ids[c.first + r], np.int64), same(size, np.int32), pa.array(w[:, 0]), pa.array(w[:, 1])], names=["item_id", "size", "w1", "w2"])

    return items.mapInArrow(run, "item_id long, size int, w1 long, w2 long").distinct()


def _prints(c: Words, span: int, k: int, sizes: list[int], keys: dict[int, np.ndarray] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the fingerprints and each short size: size, places over all rows of the chunk, hashes; those in ``keys``, if given."""
    rows, bounds = c.rows, c.bounds
    for size in sizes:
        if size == span:
            at, h = winnow(c.hashes, c.counts, span, k)
        else:
            h = gram_hashes(c.hashes, size)
            at = np.flatnonzero(np.arange(len(h)) + size <= bounds[rows[: len(h)] + 1])
            h = h[at]
        if keys is not None:
            own = keys[size]
            found = own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h
            at, h = at[found], h[found]
        yield size, at, h


WINDOWS = "id long, t long, n_words long, size int, start int, w1 long, w2 long"


def _extended(c: Words, own: pa.RecordBatch, hits: dict[int, np.ndarray], span: int, k: int, all_rows: bool) -> pa.RecordBatch:
    """The windows that hold a hit; with ``all_rows``, also a row of size 0 for each document. own: id, t; hits: places by size."""
    bounds, rows, parts = c.bounds, c.rows, []
    for size, at in hits.items():
        back = span - k if size == span else 0
        around = np.unique((at[:, None] - np.arange(back + 1)).ravel())
        around = around[around >= 0]
        last = around + size - 1
        around = around[(last < len(rows)) & (rows[np.minimum(last, len(rows) - 1)] == rows[around])] if len(around) else around
        for r in np.unique(rows[around]).tolist():
            a, b = int(bounds[r]), int(bounds[r + 1])
            words = [c.data[s:e].tobytes() for s, e in zip(c.starts[a:b], c.ends[a:b], strict=True)]
            starts = around[(around >= a) & (around < b)] - a
            parts.append((np.full(len(starts), r), np.full(len(starts), size), starts, _digests(words, starts.tolist(), size)))
    if all_rows:
        n = len(c.counts)
        parts.append((np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2), np.int64)))
    row, size, start, digest = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (*[np.zeros(0, np.int64)] * 3, np.zeros((0, 2), np.int64))
    row = row.astype(np.int64)
    cols = [own.column(0).take(pa.array(row)), own.column(1).take(pa.array(row)), pa.array(c.counts[row].astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
    return pa.record_batch(cols, names=[x.split()[0] for x in WINDOWS.split(", ")])


def document_windows(docs: DataFrame, prints: DataFrame, span: int, k: int, all_rows: bool) -> DataFrame:
    """WINDOWS of the documents (``keyed_text``): those around a fingerprint that an item has, written."""
    spark, n = docs.sparkSession, prints.count()
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())
    if n <= MAX_PRINTS:
        own = prints.toArrow()
        h, of = own["h"].to_numpy().view(U64), own["size"].to_numpy()
        shared = spark.sparkContext.broadcast({s: np.sort(h[of == s]) for s in sizes})

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text"):
                for c in word_chunks(batch.column(2), ALNUM):
                    hits = {s: at for s, at, _ in _prints(c, span, k, sizes, shared.value) if len(at)}
                    yield _extended(c, batch.slice(c.first, c.last - c.first), hits, span, k, all_rows)

        return written(docs.mapInArrow(probed, WINDOWS), "windows")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for c in word_chunks(batch.column(2), ALNUM):
                rows, bounds, own = c.rows, c.bounds, batch.slice(c.first, c.last - c.first)
                for s, at, h in _prints(c, span, k, sizes, None):
                    row = rows[at]
                    place = (at - bounds[row]) | (s << 32)
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.full(len(h), s, np.int32)), own.column(0).take(pa.array(row)), own.column(1).take(pa.array(row)), pa.array(place)], names=["h", "size", "id", "t", "place"])

    hits = docs.mapInArrow(printed, "h long, size int, id long, t long, place long").join(prints, ["h", "size"], "left_semi")
    hits = written(hits.groupBy("id", "t").agg(F.collect_set("place").alias("places")), "hits")
    those = docs.join(F.broadcast(hits.select("id", "t")), ["id", "t"], "left_semi") if hits.count() <= MAX_IDS else docs
    both = those.join(hits, ["id", "t"]).select("id", "t", "text", "places")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for c in word_chunks(batch.column(2), ALNUM):
                own, bounds, found = batch.slice(c.first, c.last - c.first), c.bounds, {}
                for r, places in enumerate(own.column(3).to_pylist()):
                    x = np.array(places, np.int64)
                    for s in np.unique(x >> 32).tolist():
                        found.setdefault(s, []).append((x[x >> 32 == s] & 0xFFFFFFFF) + bounds[r])
                yield _extended(c, own, {s: np.concatenate(x) for s, x in found.items()}, span, k, False)

    out = both.mapInArrow(extended, WINDOWS)
    if all_rows:

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text"):
                for c in word_chunks(batch.column(2), ALNUM, hashed=False):
                    yield _extended(c, batch.slice(c.first, c.last - c.first), {}, span, k, True)

        out = out.unionByName(docs.mapInArrow(counted, WINDOWS))
    out = written(out, "windows")
    discard(hits)
    return out


def _merged(hits: DataFrame) -> DataFrame:
    """id, t, n_words, n_hit, spans (of hit words: first, end) of documents with windows that an item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            places, spans, n_hit = batch.column(3), [], []
            offs, x = places.offsets.to_numpy(), places.values.to_numpy()
            for a, b in zip(offs, offs[1:], strict=False):
                own = np.sort(x[a:b])
                start = own >> 8
                end = np.maximum.accumulate(start + (own & 0xFF))
                new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                ends = end[np.append(new[1:] - 1, len(own) - 1)]
                spans.append([{"first": i, "end": j} for i, j in zip(start[new].tolist(), ends.tolist(), strict=True)])
                n_hit.append(int((ends - start[new]).sum()))
            yield pa.record_batch([*batch.columns[:3], pa.array(n_hit, pa.int64()), pa.array(spans, kind)], names=["id", "t", "n_words", "n_hit", "spans"])

    # a place and a size in one number: sizes are no more than the span, which is below 256
    place = F.shiftleft(F.col("start").cast("long"), 8) + F.col("size")
    by_doc = hits.groupBy("id", "t").agg(F.max("n_words").alias("n_words"), F.collect_set(place).alias("places"))
    return by_doc.mapInArrow(run, "id long, t long, n_words long, n_hit long, spans array<struct<first:int,end:int>>")


def _found(docs: DataFrame, items: DataFrame, span: int, k: int, all_rows: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of the documents, those that an item has, and the items' windows."""
    if not 0 < k <= span < 256:
        raise ValueError(f"no windows of {span} words with grams of {k}")
    windows = document_windows(docs, written(item_prints(items, span, k), "prints"), span, k, all_rows)
    own = written(item_windows(items, span), "item-windows")
    keys = ["size", "w1", "w2"]
    return windows, windows.where("size > 0").join(own.select(*keys).distinct(), keys, "left_semi"), own


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of those that occur), spans (of hit words: first, end) of every row."""
    windows, hits, own = _found(keyed_text(docs, id_col, text_col), id_text(items, item_col, item_text_col), span, k, True)
    keys = ["size", "w1", "w2"]
    by_item = hits.select("id", "t", *keys).distinct().join(own, keys).select("id", "t", "item_id").distinct()
    by_item = by_item.groupBy("id", "t").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    found = _merged(hits).drop("n_words").join(by_item, ["id", "t"])
    out = windows.where("size = 0").select("id", "t", "n_words").join(found, ["id", "t"], "left")
    unless = lambda c: F.when(c != LEAST, c)
    return out.select(
        unless(F.col("id")).alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.transform("items", unless), F.array().cast("array<long>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")).alias("spans"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """The rows that aren't contaminated, as they are and, while the others are few enough, where they are."""
    windows, hits, own = _found(keyed_text(docs, id_col, text_col), id_text(items, item_col, item_text_col), span, k, False)
    bad = written(_merged(hits).where(contaminated(F.col("n_words"), F.col("n_hit"))).select("id", "t"), "contaminated")
    discard(windows, own)
    return matching(docs, bad, "left_anti", id_col, text_col)


def contaminated(n_words, n_hit):
    """Whether a twentieth of a document's words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))
