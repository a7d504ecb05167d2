"""Connected components by alternating large and small stars, with DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """id, label (the least id of its component) of every end of an edge that isn't the least itself.

    edges: u, v; either order, repeated or of a node to itself. Each round is written, so a lost executor costs a round,
    and the round before removed.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            out = now.select(F.col("u").alias("id"), F.col("v").alias("label"))
            out._tidegate_path = now._tidegate_path
            return out
        before = state
        both = now.union(now.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select("v", "m").union(lower).toDF("u", "v").distinct()
        old, now = now, written(small, "edges")
        discard(old)
    raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")
