"""Near duplicates: MinHash bands propose pairs, odd sketches sift them, full shingle sets decide, components follow.

A document's set is that of its distinct word shingles; a text of fewer words is one shingle as a whole, one without words
has none and is linked with nothing. Documents of equal sets are one class, which goes on as one of its rows. Classes are
linked where the sets' similarity is the threshold or more.

1. A class has SAMPLES minima of hashes. Runs of ROWS of them are its bands; two classes of a similarity of 0.75 share
   none of the 32 bands with probability 5e-6.
2. All minima are folded into a bitmap of BITS parities (an odd sketch). The bits in which two sketches differ estimate
   their similarity; ``sketch_limit`` is the number that a pair at the threshold exceeds with probability MISS.
3. Each band bucket links its members to its hub, the member that meets most others over all its buckets. The pairs that
   sketches and set sizes allow are compared by their full sets (64-bit hashes of shingles), and linked ones merged.
4. Where members of a bucket are then still in other components than its hub, all members of it are compared by an exact
   prefix filter: shingles are ordered by how many of these classes have them, and two sets can only be linked if the rarest
   quarter of the larger and the rarest seventh of the smaller meet. Shingles within one component, which can link nothing
   new, come first and aren't joined. So copies linked to a hub are never expanded into pairs, nor are texts that share
   only what is common. What passes by place, size and sketch is compared by full sets.

Rows are the nodes, not ids: rows of one doc_id with different texts are judged each by its own text. A null id counts as
below all others. Ids of linked rows decide the class and component id (the least), also where they are repeated. An empty
table gives no rows; long texts are taken whole. Other columns aren't read and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST, MAX_IDS, NONSPACE, U64, Words, discard, gram_hashes, keyed_text, matching, mix, small_batches, table, word_chunks, written
from .components import components

SHINGLE, PERCENT = 5, 75
SAMPLES, ROWS, BITS = 128, 4, 256
MISS = 1e-8
#: Classes of more rows than this and than a thousandth of all rows are sent to the rows: a thousand at most.
HOT_ROWS = 1000
_SEEDS = np.random.default_rng(20240229)
_TIMES = _SEEDS.integers(0, 1 << 32, SAMPLES, np.uint32, endpoint=False) | np.uint32(1)
_PLUS = _SEEDS.integers(0, 1 << 32, SAMPLES, np.uint32, endpoint=False)


@lru_cache
def sketch_limit(percent: int = PERCENT, samples: int = SAMPLES, bits: int = BITS, miss: float = MISS) -> int:
    """The least number of differing bits that a pair at the threshold exceeds with no more probability than ``miss``.

    Each sample that differs (one in 100 / (100 - percent)) flips two of ``bits`` parities at random.
    """
    p, odd = 1 - percent / 100, np.zeros(bits + 1)
    odd[0], total, k = 1, np.zeros(bits + 1), np.arange(bits + 1)
    for d in range(samples + 1):
        total += exp(lgamma(samples + 1) - lgamma(d + 1) - lgamma(samples - d + 1) + d * log(p) + (samples - d) * log(1 - p)) * odd
        for _ in range(2):
            up, down = odd * (bits - k) / bits, odd * k / bits
            odd = np.concatenate([[0], up[:-1]]) + np.concatenate([down[1:], [0]])
    tail = np.cumsum(total[::-1])[::-1]
    return int(next(n for n in range(bits + 1) if n == bits or tail[n + 1] <= miss))


def shingle_sets(c: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after another, and their numbers."""
    n, bounds, rows = c.counts, c.bounds, c.rows
    g = gram_hashes(c.hashes, size)
    whole = np.flatnonzero(np.arange(len(g)) + size <= bounds[rows[: len(g)] + 1])
    h, own = g[whole], rows[whole]
    for few in range(1, size):
        if len(at := np.flatnonzero(n == few)):
            h, own = np.concatenate([h, gram_hashes(c.hashes, few)[bounds[at]]]), np.concatenate([own, at])
    order = np.argsort(h)
    order = order[np.argsort(own[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.bincount(own[new], minlength=len(n))


def minima(sets: np.ndarray, counts: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples of rows that have shingles, each mixed with its number."""
    starts = np.cumsum(counts) - counts
    low = (sets >> U64(32)).astype(np.uint32)
    out = np.empty((len(counts), samples), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(samples):
            out[:, i] = np.minimum.reduceat((low ^ _PLUS[i]) * _TIMES[i], starts)
        return mix(out.astype(U64) + (np.arange(samples, dtype=U64) << U64(32)))


def odd_sketch(own: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the places that the samples fall on, 64 to an integer."""
    rows = len(own)
    odd = np.bincount((np.arange(rows)[:, None] * bits + (own % U64(bits)).astype(np.int64)).ravel(), minlength=rows * bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64).reshape(rows, bits // 64)


def signatures(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows that have shingles: two sums that identify the set, bands, and odd sketches."""
    starts = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        h = mix(sets ^ U64(0x2545F4914F6CDD1D))
        classes = np.stack([np.add.reduceat(h, starts), np.add.reduceat(mix(h + U64(0x632BE59BD9B4E019)), starts)], 1)
        own = minima(sets, counts, SAMPLES)
        bands = np.zeros((len(counts), SAMPLES // ROWS), U64)
        for i in range(ROWS):
            bands = mix(bands * U64(0x9FB21C651E98DF25) + own[:, i::ROWS])
    return classes.view(np.int64), bands.view(np.int64), odd_sketch(own, BITS)


SKETCH = [f"s{i}" for i in range(BITS // 64)]


def _lists(sets: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(sets.view(np.int64)))


def profiles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """id, t, n (set size), c1 and c2 (the class), bands, sketch of every row of ``keyed_text``."""
    names = ["id", "t", "n", "c1", "c2", "bands", *SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for c in word_chunks(batch.column(2), NONSPACE):
                sets, n = shingle_sets(c, shingle)
                some, k = n > 0, SAMPLES // ROWS
                classes, bands, sketch = np.zeros((len(n), 2), np.int64), np.zeros((0, k), np.int64), np.zeros((len(n), len(SKETCH)), np.int64)
                if some.any():
                    classes[some], bands, sketch[some] = signatures(sets, n[some])
                own = batch.slice(c.first, c.last - c.first)
                cols = [own.column(0), own.column(1), pa.array(n.astype(np.int64)), pa.array(classes[:, 0]), pa.array(classes[:, 1]), _lists(bands.ravel(), some * k)]
                yield pa.record_batch([*cols, *(pa.array(sketch[:, i]) for i in range(len(SKETCH)))], names=names)

    return docs.mapInArrow(run, "id long, t long, n long, c1 long, c2 long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH))


def _sifted(limit: int, percent: int):
    """Whether two rows, a and b, can be linked by their sizes and sketches."""
    differ = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in SKETCH), F.lit(0))
    return (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & (differ <= limit)


def full_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and set (sorted hashes) of the nodes (node, id, t), written.

    The texts stay where they are while the ids are few enough to be sent to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for c in word_chunks(batch.column(1), NONSPACE):
                yield pa.record_batch([batch.column(0).slice(c.first, c.last - c.first), _lists(*shingle_sets(c, shingle))], names=["node", "set"])

    n = nodes.count()
    own = docs.join(F.broadcast(nodes) if n <= MAX_IDS else nodes, ["id", "t"]).select("node", "text")
    sets = written(own.mapInArrow(run, "node long, set array<long>"), "sets")
    if sets.count() == n:
        return sets
    once = written(sets.dropDuplicates(["node"]), "sets")  # rows that are repeated have a set each
    discard(sets)
    return once


def _in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sides = [(batch.column(k).offsets.to_numpy(), batch.column(k).values.to_numpy().view(U64)) for k in (2, 3)]
    for i in range(batch.num_rows):
        yield tuple(values[offs[i] : offs[i + 1]] for offs, values in sides)


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in _pairs(batch):
                both = int(_in(x, y).sum() if len(x) <= len(y) else _in(y, x).sum())
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v").select("u", "v", "a", "b")
    return written(met.mapInArrow(run, "u long, v long").distinct(), "links")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int, possible: Callable[[], Column]) -> DataFrame:
    """u, v: the pairs of different labels, one of them loose, that can be linked and share a shingle of their prefixes.

    nodes: node, label, loose, n and what ``possible`` reads. Exact: let all shingles have one order, those first that only one
    component has. Linked sets have ``percent`` of the larger in common, and 2 * percent / (100 + percent) of the smaller. So
    the first common shingle is among the first ``n - common + 1`` of each, and what follows it in both is common enough.
    """
    shingles = nodes.select("node", "label").join(sets, "node").select("node", "label", F.explode("set").alias("s"))
    often = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("s", "often")
    shared = shingles.join(often, "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("shared"))
    own = nodes.join(shared, "node").withColumn("alone", F.expr("cast(n - size(shared) AS int)"))
    prefix = F.expr(f"cast(greatest(0, n - (n * {percent} + 99) div 100 + 1 - alone) AS int)")
    places = own.select(*nodes.columns, "alone", F.posexplode(F.slice("shared", F.lit(1), prefix)).alias("i", "x"))
    places = places.select(*nodes.columns, (F.col("alone") + F.col("i")).alias("place"), F.col("x.s").alias("s"))
    places = written(places, "prefixes")
    smaller = places.where(f"place <= n - (2 * {percent} * n + {percent + 99}) div {percent + 100}")
    a, b = places.alias("a"), smaller.alias("b")
    order = (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") > F.col("b.node")))
    apart = (F.col("a.label") != F.col("b.label")) & (F.col("a.loose") | F.col("b.loose"))
    follow = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    enough = (100 + percent) * follow >= percent * (F.col("a.n") + F.col("b.n"))
    found = a.join(b, (F.col("a.s") == F.col("b.s")) & order & apart & enough & possible())
    out = written(found.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct(), "beside")
    discard(places)
    return out


def linked(distinct: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """id, label of linked classes: the least node of each component. distinct: node, id, t, n, bands, sketch."""
    limit = sketch_limit(percent)
    # buckets of two members or more; the hub is the member that meets most others over all its buckets, of these the least
    members = distinct.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(members.join(shared, "bucket"), "members")
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    hubs = members.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("node")).alias("least"))).alias("hub"))
    near = written(members.join(hubs.select("bucket", (-F.col("hub.least")).alias("hub")), "bucket").select("node", "hub").distinct(), "near")
    discard(members)
    short = distinct.select("node", "n", *SKETCH)
    sets = full_sets(docs, near.select("node").distinct().join(distinct.select("node", "id", "t"), "node"), shingle)
    pairs = near.where("node <> hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
    pairs = pairs.join(short.alias("a"), F.col("u") == F.col("a.node")).join(short.alias("b"), F.col("v") == F.col("b.node"))
    stars = written(pairs.where(_sifted(limit, percent)).select("u", "v"), "stars")
    links = compared(stars, sets, percent)
    labels = components(links)
    # what has a hub in common, but isn't in one component yet
    top = labels.select(F.col("id").alias("hub"), F.col("label").alias("top"))
    named = near.join(labels.withColumnRenamed("id", "node"), "node", "left").join(top, "hub", "left").select("node", "hub", F.coalesce("label", "node").alias("label"), F.coalesce("top", "hub").alias("top"))
    named = written(named, "named")
    mixed = named.join(named.where("label <> top").select("hub").distinct(), "hub", "left_semi")
    mixed = written(mixed.groupBy("node", "label").agg(F.bool_or(F.col("label") != F.col("top")).alias("loose")).join(short, "node"), "mixed")
    discard(near, named)
    beside = prefix_pairs(mixed, sets, percent, lambda: _sifted(limit, percent))
    more = compared(beside.join(stars, ["u", "v"], "left_anti"), sets, percent)
    discard(mixed, beside, stars, links, sets)
    if not more.isEmpty():
        first, labels = labels, components(labels.select(F.col("id").alias("u"), F.col("label").alias("v")).union(more))
        discard(first)
    discard(more)
    return labels


def grouped(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, t, n, class_id, component_id, kept of every row of ``keyed_text``.

    kept: the row's text is that of its component's first row (by id); all rows without words are kept.
    """
    rows = written(profiles(docs, shingle).withColumn("row", F.monotonically_increasing_id()), "profiles")
    first = F.min(F.struct("id", "row", "t")).alias("first")
    classes = rows.where("n > 0").groupBy("c1", "c2", "n").agg(first, F.count(F.lit(1)).alias("size"))
    classes = written(classes.select("c1", "c2", "n", "size", F.col("first.row").alias("node"), F.col("first.id").alias("class_id"), F.col("first.t").alias("class_t")), "classes")
    distinct = rows.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi")
    distinct = written(distinct.select("node", "id", "t", "n", "bands", *SKETCH), "distinct")
    labels = linked(distinct, docs, shingle, percent)
    named = classes.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    # only components of two classes or more: those whose least node is a label of another
    several = labels.select("label").distinct()
    tops = named.join(several, "label", "left_semi").groupBy("label").agg(F.min(F.struct("class_id", "node")).alias("top"))
    named = named.join(tops, "label", "left").withColumn("component_id", F.coalesce("top.class_id", "class_id")).withColumn("first", F.coalesce("top.node", "node") == F.col("node"))
    found = written(named.where(~F.col("first") | (F.col("size") > 1) | F.col("top").isNotNull()).select("c1", "c2", "n", "size", "class_id", "class_t", "component_id", "first"), "found")
    discard(classes, distinct, labels)
    # a row that isn't found is a class and a component of its own; rows of hot classes stay where they are
    most = max(HOT_ROWS, rows.count() // 1000)
    narrow, keys = rows.select("id", "t", "n", "c1", "c2"), ["c1", "c2", "n"]
    hot, rest = found.where(F.col("size") > most).drop("size"), found.where(F.col("size") <= most).drop("size")
    sent = narrow.join(F.broadcast(hot), keys, "left")
    joined = sent.where("class_id IS NULL").select(*narrow.columns).join(rest, keys, "left")
    out = sent.where("class_id IS NOT NULL").unionByName(joined)
    kept = F.coalesce(F.col("first") & (F.col("id") == F.col("class_id")) & (F.col("t") == F.col("class_t")), F.lit(True))
    return out.select("id", "t", "n", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"), kept.alias("kept"))


def _unless_least(c: str, name: str) -> Column:
    return F.when(F.col(c) != LEAST, F.col(c)).alias(name)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (least id of equal sets), component_id (least id reachable) of every row."""
    out = grouped(keyed_text(docs, id_col, text_col), shingle, percent)
    return out.select(_unless_least("id", "doc_id"), F.col("n").alias("n_shingles"), _unless_least("class_id", "class_id"), _unless_least("component_id", "component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, as it is: the one of the least id, null being below all others; and all without words.

    Where its id and text are in several rows, which are then copies of one another, one of these stays. Other texts of
    the same id are other documents.
    """
    out = written(grouped(keyed_text(docs, id_col, text_col), shingle, percent).select("id", "t", "n", "kept"), "verdicts")
    gone = written(out.where("NOT kept").select("id", "t").distinct(), "gone")
    again = written(out.where("kept AND n > 0").groupBy("id", "t").count().where("count > 1").select("id", "t"), "again")
    discard(out)
    left = matching(docs, gone, "left_anti", id_col, text_col, MAX_IDS)
    if again.isEmpty():
        return left
    one = matching(left, again, "left_semi", id_col, text_col, MAX_IDS).dropDuplicates([id_col, text_col])
    return matching(left, again, "left_anti", id_col, text_col, MAX_IDS).unionByName(one)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")
