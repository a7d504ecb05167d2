"""Replicated writes and reads: who stays alive, do the copies agree, whom to read, and where to go on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_outcomes(steps: DataFrame, group: str, replica: str, step: str, ok: str) -> DataFrame:
    """Each step of a group, sent to all replicas still alive: used, took, succeeded, and a status.

    A replica that fails once is not written to again. A step succeeds if one replica takes it, has failed if none of those
    used does, and is in error (no_replica) if none was left. steps: a row for each replica that the group has.
    """
    failed = steps.where(~F.col(ok)).groupBy(group, replica).agg(F.min(step).alias("_failed"))
    lived = steps.join(failed, [group, replica], "left").withColumn("_alive", F.col("_failed").isNull() | (F.col(step) <= F.col("_failed")))
    used = lived.groupBy(group, step).agg(F.count_if("_alive").alias("used"), F.count_if(F.col("_alive") & F.col(ok)).alias("took"))
    status = F.when(F.col("took") > 0, "ok").when(F.col("used") > 0, "failed").otherwise("no_replica")
    return used.withColumn("succeeded", F.col("took") > 0).withColumn("status", status)


def byte_agreement(copies: DataFrame, group: str, n_bytes: str) -> DataFrame:
    """Whether all live replicas of a group report equal bytes."""
    out = copies.groupBy(group).agg(F.count_distinct(n_bytes).alias("n"), F.min(n_bytes).alias("least"), F.max(n_bytes).alias("most"))
    return out.select(group, "least", "most", (F.col("n") == 1).alias("agree"))


def first_complete(replicas: DataFrame, group: str, replica: str, complete: str) -> DataFrame:
    """The replica to read: the first complete one; null where none is."""
    return replicas.groupBy(group).agg(F.min(F.when(F.col(complete), F.col(replica))).alias("source"))


def resumed(first: DataFrame, second: DataFrame, consumed: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Blocks as a reader gets them that fails over: what it consumed from the first copy, the rest from the second.

    consumed: keys and ``n``, blocks taken; keys that aren't there are read from the second copy alone.
    """
    keys = list(keys)
    head = first.join(consumed, keys).where(F.col(seq) <= F.col("n")).drop("n").withColumn("source", F.lit("first"))
    tail = second.join(consumed, keys, "left").where(F.col(seq) > F.coalesce("n", F.lit(0))).drop("n").withColumn("source", F.lit("second"))
    return head.unionByName(tail)


def count_differences(read: DataFrame, taken: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Keys whose counts differ, or that one side lacks."""
    a, b = read.select(*keys, F.col(n).alias("n_read")), taken.select(*keys, F.col(n).alias("n_taken"))
    return a.join(b, list(keys), "full_outer").where(~F.col("n_read").eqNullSafe(F.col("n_taken")))


def content_differences(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Blocks that aren't the same in both copies, over all blocks, repeated ones as often as they are more: side says where.

    Each copy is read once, and counted before it is moved.
    """
    own = [*keys, value]
    both = first.select(*own, F.lit(1).alias("_n")).unionByName(second.select(*own, F.lit(-1).alias("_n")))
    more = both.groupBy(*own).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))
    return more.withColumn("_k", times).select(*own, F.when(F.col("_n") > 0, "first").otherwise("second").alias("side"))


def in_turn(blocks: DataFrame, partition: str, groups: int) -> DataFrame:
    """Blocks with the group that holds them, those of one group after those of another, as a reader goes through them."""
    return blocks.withColumn("group_id", F.pmod(F.col(partition), F.lit(groups))).orderBy("group_id")
