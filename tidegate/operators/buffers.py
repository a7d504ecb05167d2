"""Block packing of a map task: records go to their partition's buffer, and buffers leave as blocks.

A buffer leaves when it reaches ``buffer`` bytes; all of a task leave when together they reach ``spill``; what is left at
the end leaves last. Since counts start again after each block, this is a fold in the order of the records and no window:
each map task's records stream by in order (Spark sorts them, on disk if need be), and two numbers a partition are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

BUFFER, SPILL = 32 << 10, 32 << 20


class Packer:
    """The buffers of one map task. Blocks are (partition, number, records, bytes), numbered as they leave."""

    def __init__(self, buffer: int, spill: int):
        self.buffer, self.spill = buffer, spill
        self.open: dict[int, list[int]] = {}
        self.total = self.blocks = 0

    def _leave(self, p: int) -> tuple[int, int, int, int]:
        n, size = self.open.pop(p)
        self.total -= size
        self.blocks += 1
        return p, self.blocks - 1, n, size

    def add(self, p: int, size: int) -> list[tuple[int, int, int, int]]:
        own = self.open.setdefault(p, [0, 0])
        own[0] += 1
        own[1] += size
        self.total += size
        if own[1] >= self.buffer:
            return [self._leave(p)]
        return self.flush() if self.total >= self.spill else []

    def flush(self) -> list[tuple[int, int, int, int]]:
        return [self._leave(p) for p in sorted(self.open)]


def pack_blocks(records: DataFrame, task: str, partition: str, seq: str, length: str, buffer: int = BUFFER, spill: int = SPILL) -> DataFrame:
    """task, p, block, n_records, bytes of each block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, packer = None, Packer(buffer, spill)
        names = ["task", "p", "block", "n_records", "bytes"]
        for f in frames:
            out = []
            for t, p, size in zip(f["task"].tolist(), f["p"].tolist(), f["length"].tolist(), strict=True):
                if t != own:
                    out += [(own, *b) for b in packer.flush()]
                    own, packer = t, Packer(buffer, spill)
                out += [(t, *b) for b in packer.add(p, size)]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(own, *b) for b in packer.flush()], columns=names)

    rows = records.selectExpr(f"cast({task} as long) task", f"cast({partition} as long) p", f"cast({seq} as long) seq", f"cast({length} as long) length")
    ordered = rows.repartition("task").sortWithinPartitions("task", "seq").select("task", "p", "length")
    return ordered.mapInPandas(run, "task long, p long, block long, n_records long, bytes long")
