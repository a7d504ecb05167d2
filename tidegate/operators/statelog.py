"""The state log: what a restart makes of it, what it may forget, and the limits that it watches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keyed import running_sum


def replay(log: DataFrame, stage: Sequence[str] = ("app", "shuffle"), seq: str = "seq") -> DataFrame:
    """Stages after a restart. log: seq, kind (stage, commit, corrupt, delete), app, shuffle, num_partitions, start, splits.

    A stage is corrupt if the log says so, if its numbers of partitions or splits differ, or if a commit of it comes before
    it is announced. Stages that never are aren't restored. Deleted apps are gone, whatever else the log has of them, before
    or after. New files start after all that were announced. ``commits`` counts commits of the stage. The rules ask only
    what comes first, so the order is kept without sorting the log.
    """
    stage = list(stage)
    of = lambda kind: F.col("kind") == kind
    out = log.where("kind <> 'delete'").groupBy(*stage).agg(
        F.min(F.when(of("stage"), F.col(seq))).alias("announced"),
        F.min(F.when(of("commit"), F.col(seq))).alias("committed"),
        F.count_if(of("commit")).alias("commits"),
        F.count_if(of("corrupt")).alias("corrupted"),
        *[F.min(F.when(of("stage"), F.col(c))).alias(f"least_{c}") for c in ("num_partitions", "splits")],
        *[F.max(F.when(of("stage"), F.col(c))).alias(f"most_{c}") for c in ("num_partitions", "splits")],
        F.max(F.when(of("stage"), F.col("start") + F.col("splits"))).alias("next_start"),
    )
    differ = (F.col("least_num_partitions") != F.col("most_num_partitions")) | (F.col("least_splits") != F.col("most_splits"))
    corrupt = (F.col("corrupted") > 0) | differ | F.coalesce(F.col("committed") < F.col("announced"), F.lit(False))
    kept = out.where("announced IS NOT NULL").join(log.where(of("delete")).select("app").distinct(), "app", "left_anti")
    return kept.select(*stage, F.when(corrupt, "corrupted").otherwise("ok").alias("status"), "commits", F.col("next_start").cast("long").alias("next_start"))


def config_mismatches(log: DataFrame, stage: Sequence[str] = ("app", "shuffle")) -> DataFrame:
    """Stages announced with different numbers of partitions or splits, and how many of each."""
    out = log.where("kind = 'stage'").groupBy(*stage).agg(F.count_distinct("num_partitions").alias("partitions"), F.count_distinct("splits").alias("splits"))
    return out.where("partitions > 1 OR splits > 1")


def stage_status(log: DataFrame, stage: Sequence[str] = ("app", "shuffle")) -> DataFrame:
    """not_started if never announced, corrupted if the log says so, else ok."""
    status = F.when(F.count_if(F.col("kind") == "stage") == 0, "not_started").when(F.count_if(F.col("kind") == "corrupt") > 0, "corrupted").otherwise("ok")
    return log.groupBy(*stage).agg(status.alias("status"))


def next_start(log: DataFrame, stage: Sequence[str] = ("app", "shuffle")) -> DataFrame:
    """Where new files of a stage start: after all that were announced."""
    return log.where("kind = 'stage'").groupBy(*stage).agg(F.max(F.col("start") + F.col("splits")).alias("next_start"))


def before_first_bad(log: DataFrame, file: str, seq: str, bad: str) -> DataFrame:
    """Items of each file before its first that can't be read; later files go on."""
    first = log.where(F.col(bad)).groupBy(file).agg(F.min(seq).alias("_first_bad"))
    return log.join(first, file, "left").where(F.col("_first_bad").isNull() | (F.col(seq) < F.col("_first_bad"))).drop("_first_bad")


def rotated(log: DataFrame, ts: str) -> DataFrame:
    """The hourly file of each item."""
    return log.withColumn("file", F.concat(F.lit("v1_"), F.date_format(ts, "yyyyMMddHH")))


def retained(log: DataFrame, ts: str, now: str, hours: int = 36) -> DataFrame:
    return log.where(F.col(ts) >= F.expr(f"timestamp_ntz'{now}' - INTERVAL {hours} HOURS"))


def liveness(events: Sequence[DataFrame], app: str, ts: str) -> DataFrame:
    """When each app was last heard of, over all kinds of events."""
    one, *more = [e.select(app, ts) for e in events]
    for e in more:
        one = one.unionByName(e)
    return one.groupBy(app).agg(F.max(ts).alias("last_seen"))


def expired(seen: DataFrame, now: str, hours: int = 6) -> DataFrame:
    return seen.withColumn("expired", F.col("last_seen") < F.expr(f"timestamp_ntz'{now}' - INTERVAL {hours} HOURS"))


def over_quota(writes: DataFrame, app: str, order: str, n_bytes: str, limit: int, width: int = 1_000_000) -> DataFrame:
    """The first write of each app that takes its sum above the limit, and the sum then.

    Apps below the limit as a whole drop out before any running sum is kept; that is kept in buckets of ``width``.
    """
    large = writes.groupBy(app).agg(F.sum(F.when(F.col(n_bytes) > 0, F.col(n_bytes))).alias("_most")).where(F.col("_most") > limit).select(app)
    running = running_sum(writes.join(large, app, "left_semi"), [app], order, n_bytes, width, "total").where(F.col("total") > limit)
    return running.groupBy(app).agg(F.min(order).alias("first_over"), F.min_by("total", order).alias("total"))


def busy(connections: DataFrame, within: str, order: str, change: str, limit: int, width: int = 1_000_000) -> DataFrame:
    """Running numbers of connections (changes of +1 and -1), with ``busy`` where they are above the limit."""
    return running_sum(connections, [within], order, change, width, "open").withColumn("busy", F.col("open") > limit)


def idle_gaps(reads: DataFrame, channel: str, ts: str, seconds: int, bucket: str = "day") -> DataFrame:
    """Reads that came after more than ``seconds`` without any on their channel.

    Reads are in order within a bucket of time; the first of a bucket follows the last of the one before.
    """
    own = reads.withColumn("_bucket", F.date_trunc(bucket, ts))
    last = own.groupBy(channel, "_bucket").agg(F.max(ts).alias("_last"))
    before = last.select(F.col(channel).alias("_channel"), F.col("_bucket").alias("_b"), F.lag("_last").over(Window.partitionBy(channel).orderBy("_bucket")).alias("_earlier"))
    inner = F.lag(ts).over(Window.partitionBy(channel, "_bucket").orderBy(ts))
    both = own.withColumn("_inner", inner).join(before, F.col(channel).eqNullSafe(F.col("_channel")) & F.col("_bucket").eqNullSafe(F.col("_b")), "left")
    both = both.withColumn("_before", F.coalesce("_inner", "_earlier")).withColumn("gap_s", F.expr(f"timestampdiff(SECOND, _before, `{ts}`)"))
    return both.where(F.col("gap_s") > seconds).drop("_before", "_inner", "_earlier", "_channel", "_b", "_bucket")


def rates(events: DataFrame, ts: str, value: str, keys: Sequence[str] = (), width: str = "1 hour", seconds: int = 3600) -> DataFrame:
    """Sums and rates a second of tumbling windows."""
    out = events.groupBy(*keys, F.window(ts, width)).agg(F.sum(value).alias("total"))
    return out.select(*keys, F.col("window.start").alias("start"), "total", F.round(F.col("total") / seconds, 6).alias("rate"))
