"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than SEGMENT characters are cut where white space follows anything else: no match of the pattern spans such
a place, nor looks back over it, so the pieces encode as the whole would. Null and empty texts have no ids. Repeated rows
come out as often as they went in; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, small_batches, table

RANKS = "byte_bpe_multi_50k.tiktoken"
SEGMENT = 1 << 16
_CUT = re.compile(r"(?<=\S)[ \t-\r]")
_LOADED: dict = {}


def load(ranks: str, pattern: str):
    """The encoding of a rank file, loaded once a process."""
    if (ranks, pattern) not in _LOADED:
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[ranks, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _LOADED[ranks, pattern]


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode_text(encoding, text: str | None, size: int = SEGMENT) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) <= size:
        return np.array(encoding.encode_ordinary(text), np.uint32)
    return np.concatenate([np.array(encoding.encode_ordinary(x), np.uint32) for x in segments(text, size)])


SCHEMA = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids: the ids as little-endian unsigned 32-bit integers.

    decoded: also ``decoded``, the raw bytes that the ids decode to, from the same pass.
    """
    ranks = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(ranks, pattern)
        for batch in small_batches(batches, "text"):
            ids = [encode_text(encoding, x) for x in batch.column(1).to_pylist()]
            cols = {"doc_id": batch.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())}
            if decoded:
                cols["decoded"] = pa.array([encoding.decode_bytes(x.tolist()) for x in ids], pa.binary())
            yield pa.record_batch(list(cols.values()), names=list(cols))

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """What encode() returned, and ``decoded``: the raw bytes of the ids; of null ids, none."""
    ranks = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(ranks, pattern)
        for batch in batches:
            out = [encoding.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(run, SCHEMA + ", decoded binary")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    return encode(docs, decoded=True).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
