"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A feature is a word, two words in a row, or two words
with one between, hashed to 2**HASH_BITS places; a text has each of its features once, with weight 1, and a bias. Training
sees at most ``max_rows`` labelled rows (those of least hash of doc_id), featurised by tasks; each coordinate has a rate of
its own, and L1 leaves few weights, which go to every task as two short arrays (never more than 2**HASH_BITS).

A table without rows to score gives none. Null and empty texts score by the bias alone. Rows whose label is null, or whose doc_id is null, are not learnt from. With
no rows to learn from, all score 0.5. Labels repeated for a doc_id count as often as they are there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, U64, Words, id_text, kept, mix, small_batches, table, word_chunks

HASH_BITS = 20
#: Labelled rows that are learnt from at most, and bytes of their texts: the driver holds no more than some 16 bytes a byte.
MAX_ROWS, MAX_BYTES = 8000, 200_000
THRESHOLD = 0.7


def features(c: Words, bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of the rows, repeated ones too, and the row of each."""
    h, rows = c.hashes, c.rows
    parts, own = [h], [rows]
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            if len(h) > gap:
                same = rows[gap:] == rows[:-gap]
                parts.append(mix(h[:-gap] * U64(0x9FB21C651E98DF25) + h[gap:] + U64(gap))[same])
                own.append(rows[gap:][same])
    return (np.concatenate(parts) >> U64(64 - bits)).astype(np.int64), np.concatenate(own)


@dataclass
class Model:
    """Weights other than 0 and their places; the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = HASH_BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.places] = self.weights
        return out

    def scores(self, c: Words, dense: np.ndarray) -> np.ndarray:
        at, rows = features(c, self.bits)
        some = np.flatnonzero(dense[at])
        once = np.unique(rows[some] << self.bits | at[some])
        sums = np.bincount(once >> self.bits, weights=dense[once & ((1 << self.bits) - 1)], minlength=len(c.counts))
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; the weights follow from z and n."""

    def __init__(self, bits: int = HASH_BITS, alpha: float = 4.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35))) - label
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g
        step = ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha
        self.bias_z += g - step * self.bias
        self.bias_n += g * g

    def model(self) -> Model:
        w = self.weights(slice(None)).astype(np.float32)
        places = np.flatnonzero(w)
        return Model(places, w[places], float(self.bias), self.bits)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn_from: Column | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, epochs: int = 8) -> Model:
    """docs: id_col, text_col; labels: id_col, label_col. learn_from: a condition on the labels' id, as ``doc_id``.

    Of the rows chosen, those with texts of more than ``max_bytes`` are left out: they aren't learnt from, but scored whole.
    """
    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    chosen = (own.where(learn_from) if learn_from is not None else own).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    # max_rows rows of two integers
    texts = id_text(docs, id_col, text_col).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for c in word_chunks(batch.column(1), ALNUM):
                at, rows = features(c)
                once = np.unique(rows << HASH_BITS | at)
                cut = np.searchsorted(once >> HASH_BITS, np.arange(len(c.counts) + 1))
                places = (once & ((1 << HASH_BITS) - 1)).astype("<i4")
                lists = [places[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                part = batch.slice(c.first, c.last - c.first)
                yield pa.record_batch([part.column(0), part.column(2), pa.array(lists, pa.binary())], names=["doc_id", "label", "places"])

    got = rows.mapInArrow(run, "doc_id long, label int, places binary").toArrow()
    order = np.random.default_rng(7)
    data = sorted(zip(got["doc_id"].to_pylist(), got["label"].to_pylist(), got["places"].to_pylist(), strict=True))
    ftrl = Ftrl()
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            ftrl.learn(np.frombuffer(data[i][2], "<i4"), data[i][1])
    return ftrl.model()


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", below: float | None = None) -> DataFrame:
    """The rows with their score; with ``below``, only those of a lesser score, and as they were.

    ValueError if ``score_col`` is to be added and there already.
    """
    if below is None and score_col in docs.columns:
        raise ValueError(f"{score_col} clashes with a column of the documents")
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, dense = kept("weights", key, lambda: (shared.value, shared.value.dense()))
        for batch in small_batches(batches, text_col):
            own = [m.scores(c, dense) for c in word_chunks(batch.column(batch.schema.get_field_index(text_col)), ALNUM)]
            score = np.concatenate(own) if own else np.zeros(0)
            if below is None:
                yield pa.record_batch([*batch.columns, pa.array(score)], names=[*batch.schema.names, score_col])
            else:
                yield batch.filter(pa.array(score < below))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema if below is not None else f"{schema}, `{score_col}` double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), learn_from=~held_out())
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
