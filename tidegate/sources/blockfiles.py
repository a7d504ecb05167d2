"""Partition files: blocks one after another, each an attempt id (64 bits), a length (32 bits, both big-endian) and bytes.

Read with Spark's binary file source, decoded in Arrow batches. A file that is cut off is corrupt as a whole: it gives one
row of its name with an error and no block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HEADER = struct.Struct(">qi")
SCHEMA = "file string, seq long, attempt long, length int, payload binary, error string"


def encode(blocks: list[tuple[int, bytes]]) -> bytes:
    return b"".join(HEADER.pack(a, len(x)) + x for a, x in blocks)


def decode(data: bytes) -> list[tuple[int, bytes]]:
    """ValueError if bytes are left over or lacking."""
    out, at = [], 0
    while at < len(data):
        if at + HEADER.size > len(data):
            raise ValueError(f"{len(data) - at} bytes are left over")
        attempt, n = HEADER.unpack_from(data, at)
        at += HEADER.size
        if n < 0 or at + n > len(data):
            raise ValueError(f"a block of {n} bytes has only {len(data) - at}")
        out.append((attempt, data[at : at + n]))
        at += n
    return out


def read(spark: SparkSession, folder: str, pattern: str = "*.data.*") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = path.rpartition("/")[2]
                try:
                    rows = [(file, k, a, len(x), x, None) for k, (a, x) in enumerate(decode(data))]
                except ValueError as e:
                    rows = [(file, 0, None, None, None, str(e))]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)
