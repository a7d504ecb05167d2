"""Attempts, commits and what can be read: blocks of the winning attempts, stages that are complete, what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a task attempt in the order that they can be reached, and the messages that lead there.
STATES = {0: "not_started", 1: "start_upload", 2: "committed"}


def attempt_states(messages: DataFrame, keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """The furthest state of each attempt; ``restarted`` marks one that was started twice. rank: 1 start, 2 commit."""
    out = messages.groupBy(*keys).agg(F.max(rank).alias("rank"), F.count_if(F.col(rank) == 1).alias("starts"))
    return out.select(*keys, F.when(F.col("rank") == 2, "committed").when(F.col("rank") == 1, "start_upload").otherwise("not_started").alias("state"), (F.col("starts") > 1).alias("restarted"))


def first_seen(messages: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """When an attempt's upload began: at its first message, whichever it was."""
    return messages.groupBy(*keys).agg(F.min(ts).alias("started"))


def winners(commits: DataFrame, keys: Sequence[str] = ("map_id",), attempt: str = "attempt") -> DataFrame:
    """The latest committed attempt of each map task."""
    return commits.groupBy(*keys).agg(F.max(attempt).alias(attempt))


def live(blocks: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of the attempts wanted; what stale attempts left is passed over."""
    return blocks.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def stale(blocks: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return blocks.join(wanted.select(*keys).distinct(), list(keys), "left_anti")


def availability(fetch: DataFrame, commits: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """For each ``by``: how many of the attempts to fetch are missing, and a status; readable if none is.

    ok, not_available (some commits are missing) or not_started (all are).
    """
    have = commits.select(*keys).distinct().withColumn("_there", F.lit(1))
    both = fetch.join(have, list(keys), "left").groupBy(*by).agg(F.count(F.lit(1)).alias("wanted"), F.count("_there").alias("there"))
    missing = (F.col("wanted") - F.col("there")).alias("missing")
    status = F.when(F.col("there") == F.col("wanted"), "ok").when(F.col("there") == 0, "not_started").otherwise("not_available")
    return both.select(*by, "wanted", missing, status.alias("status"))


def missing(fetch: DataFrame, commits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The attempts that a reader still waits for."""
    return fetch.join(commits.select(*keys).distinct(), list(keys), "left_anti")


def to_every_group(attempts: DataFrame, groups: int) -> DataFrame:
    """The commits that a task sends: one to each group, those that got no data too."""
    return attempts.withColumn("group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))


def file_state(recorded: Column, actual: Column) -> Column:
    return F.when(actual.isNull(), "missing").when(actual == 0, "empty").when(actual < recorded, "short").otherwise("ok")


def map_status_verdict(n_maps: Column, n_servers: Column, want_maps: int, want_servers: int) -> Column:
    return F.when(n_maps != want_maps, "wrong_maps").when(n_servers != want_servers, "wrong_servers").otherwise("ok")


def snapshot(blocks: DataFrame, commits: DataFrame, by: Sequence[str], keys: Sequence[str], length: str) -> DataFrame:
    """What a stage's files hold when it is first read: blocks and bytes of the committed attempts."""
    return live(blocks, commits, keys).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("length"))


def save_once(rows: DataFrame, path: str) -> DataFrame:
    """The rows as they were first saved: written if nothing is there yet, read back in any case."""
    rows.write.mode("ignore").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def start_again(rows: DataFrame, path: str) -> DataFrame:
    """A new start takes the place of what was saved."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
