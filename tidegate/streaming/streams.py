"""The data plane as streams: state machines by attempt, partitions that become readable, expiry, rates, idle channels.

Each function takes a streaming DataFrame and returns one. State is kept by key in Spark's state store and is a few numbers
a key, or the attempts that a partition still waits for. ``settled`` runs a stream over all that is there now and gives its
rows as a table; its checkpoint and rows go to the shared folder. Where there are many keys, set
``spark.sql.streaming.stateStore.providerClass`` to Spark's RocksDB provider, which keeps state on disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = ["not_started", "start_upload", "committed"]


def read(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def _folder(spark: SparkSession) -> str:
    """In the folder that all executors share; only a local session gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidegate-stream-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def settled(stream: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """The rows that the stream has given when all input is taken: with ``keys`` the last row of each, in complete mode those
    of the last batch, else all."""
    spark, to = stream.sparkSession, _folder(stream.sparkSession)
    last = [-1]

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{to}/rows/batch={number}")
        last[0] = max(last[0], number)

    run = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{to}/checkpoint").foreachBatch(store).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    which = f"batch={last[0]}" if mode == "complete" else "*"
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{to}/rows/{which}")
    if not keys:
        return rows.drop("_batch")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_last")).select(*keys, "_last.*")


def attempt_states(messages: DataFrame, app: str = "app", attempt: str = "attempt", rank: str = "rank") -> DataFrame:
    """app, attempt, state, restarted, in update mode: the state after each batch that has messages of the attempt."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        furthest, starts = state.get if state.exists else (0, 0)
        for f in frames:
            furthest, starts = max(furthest, int(f["rank"].max())), starts + int((f["rank"] == 1).sum())
        state.update((furthest, starts))
        yield pd.DataFrame([(*key, STATES[furthest], starts > 1)], columns=["app", "attempt", "state", "restarted"])

    own = messages.select(F.col(app).alias("app"), F.col(attempt).alias("attempt"), F.col(rank).cast("int").alias("rank"))
    return own.groupBy("app", "attempt").applyInPandasWithState(step, "app long, attempt long, state string, restarted boolean", "furthest int, starts int", "update", GroupStateTimeout.NoTimeout)


def readable(commits: DataFrame, wanted: DataFrame) -> DataFrame:
    """p and n of each partition once, when all attempts that it waits for have committed. commits: p, attempt.

    wanted: p, attempt; a table, joined in. State is a partition's list of those that it still waits for.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, n = (set(state.get[0]), state.get[1]) if state.exists else (None, 0)
        open_before = left is None or bool(left)
        for f in frames:
            if left is None:
                left = {int(x) for x in f["want"].iloc[0]}
                n = len(left)
            left -= set(f["attempt"].tolist())
        state.update((sorted(left), n))
        if open_before and not left:
            yield pd.DataFrame([(key[0], n)], columns=["p", "n"])

    own = wanted.groupBy("p").agg(F.collect_set(F.col("attempt").cast("long")).alias("want"))
    both = commits.select(F.col("p").cast("long").alias("p"), F.col("attempt").cast("long").alias("attempt")).join(own, "p")
    return both.groupBy("p").applyInPandasWithState(step, "p long, n long", "missing array<long>, n int", "append", GroupStateTimeout.NoTimeout)


def live_blocks(blocks: DataFrame, won: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of the attempts that have won, a table; what stale ones send, however late, is passed over by its id."""
    return blocks.join(won.select(*keys).distinct(), list(keys), "left_semi")


def last_seen(events: DataFrame, key: str, ts: str) -> DataFrame:
    """When each key was last heard of, in update mode. Any order of events gives the same."""
    return events.groupBy(F.col(key).alias("key")).agg(F.max(ts).alias("last_seen"))


def expiring(events: DataFrame, key: str, ts: str, delay: str, hours: int) -> DataFrame:
    """key and last_seen of what wasn't heard of for ``hours`` of event time, in append mode; it is then forgotten."""
    ms = hours * 3600 * 1000

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(k[0], pd.Timestamp(last, unit="ms"))], columns=["key", "last_seen"])
            return
        last = state.get[0] if state.exists else 0
        for f in frames:
            last = max(last, int(f["ts"].max().value // 1_000_000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ms, state.getCurrentWatermarkMs() + 1))

    own = events.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return own.groupBy("key").applyInPandasWithState(step, "key long, last_seen timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def rates(events: DataFrame, ts: str, value: str, width: str = "1 hour", delay: str | None = "10 minutes") -> DataFrame:
    """Sum and count by window. Rows later than ``delay`` are dropped; with None none is, and all windows are kept as state."""
    own = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    own = own.withWatermark("_ts", delay) if delay is not None else own
    out = own.groupBy(F.window("_ts", width)).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "total", "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str, delay: str | None = "10 minutes") -> DataFrame:
    """Spans of a channel without a pause of ``gap``; where one ends, the channel was idle.

    Rows later than ``delay`` are dropped; with None none is, and all sessions are kept as state (in complete mode).
    """
    own = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    own = own.withWatermark("_ts", delay) if delay is not None else own
    out = own.groupBy(key, F.session_window("_ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
