"""Where partitions go: how many servers, in which replica groups, with which fan-out, and what a writer picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def server_count(maps: Column, partitions: Column, replicas: Column, least: Column, most: Column, ratio: Column) -> Column:
    """Servers of a shuffle: one for ``ratio`` maps or partitions, within bounds, each ``replicas`` times."""
    wanted = F.ceil(F.greatest(maps, partitions) / ratio)
    return F.greatest(F.greatest(F.least(most, wanted, partitions), F.lit(1)) * replicas, least).cast("long")


def fanout(servers: Column, replicas: Column, partitions: Column, least: Column) -> Column:
    """Groups that share a partition: more than one only if servers are asked for beyond the partitions."""
    groups = F.floor(servers / replicas)
    return F.when((least > 1) & (groups > partitions), F.floor(groups / partitions)).otherwise(1).cast("long")


def split_count(maps: Column, maps_per_split: Column, least: Column, most: Column) -> Column:
    return F.least(F.greatest(F.ceil(maps / maps_per_split), least), most).cast("long")


def writer_threads(servers: Column, most: Column) -> Column:
    return F.least(F.ceil(servers / 8), most).cast("long")


def replica_groups(servers: DataFrame, order: str, replicas: int, within: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive servers in groups of ``replicas``: group_id and members; a group that isn't full is dropped.

    ValueError if ``replicas`` is less than 1. Without ``within``, servers are few: they are numbered in one place.
    """
    if replicas < 1:
        raise ValueError("a group has one replica or more")
    w = Window.partitionBy(*within).orderBy(order)
    numbered = servers.withColumn("group_id", F.floor((F.row_number().over(w) - 1) / replicas).cast("long"))
    groups = numbered.groupBy(*within, "group_id").agg(F.array_sort(F.collect_list(order)).alias("members"))
    return groups.where(F.size("members") == replicas)


def groups_of_partitions(partitions: DataFrame, groups: int, fan: int) -> DataFrame:
    """Each partition's groups, ``fan`` in a row from its own, round the circle. partitions: p. ValueError if fan > groups."""
    if fan > groups or fan < 1:
        raise ValueError(f"a partition can't have {fan} of {groups} groups")
    return partitions.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(fan - 1)))).withColumn("group_id", F.pmod(F.pmod(F.col("p"), F.lit(groups)) + F.col("i"), F.lit(groups)))


def routed_group(partition: Column, attempt: Column, groups: int, fan: int) -> Column:
    """The one of a partition's groups that a task attempt writes to."""
    own = F.pmod(partition, F.lit(groups))
    return F.pmod(own + F.pmod(attempt, F.lit(fan)), F.lit(groups)) if fan > 1 else own


def routed_split(attempt: Column, splits: int) -> Column:
    return F.pmod(attempt, F.lit(splits))


def candidates(servers: DataFrame, most: int, within: tuple[str, ...] = (), order: str = "server_id") -> DataFrame:
    """Those that are asked, in the registry's order: a few more than ``most``, since some may not be reached."""
    w = Window.partitionBy(*within).orderBy(order)
    return servers.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most + min(5, most)).drop("_k")


def ranked(servers: DataFrame, most: int, within: tuple[str, ...] = (), tolerance: int = 500) -> DataFrame:
    """The ``most`` best reachable servers: by latency in steps of ``tolerance``, then connections, then id.

    A null latency means that a server wasn't reached. Steps make the order transitive.
    """
    w = Window.partitionBy(*within).orderBy(F.floor(F.col("latency") / tolerance), "conns", "server_id")
    return servers.where(F.col("latency").isNotNull()).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)


def sampled(servers: DataFrame, n: int, seed: int) -> DataFrame:
    """n servers, the same ones for a seed."""
    return servers.orderBy(F.md5(F.concat_ws("-", F.col("server_id").cast("string"), F.lit(str(seed)))), "server_id").limit(n)


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Servers that are not what they were, or gone: restarts that a reader has to hear of."""
    both = old.select(key, F.col(value).alias("was")).join(new.select(key, F.col(value).alias("now")), key, "left")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def newest(entries: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """Of each key, the value of the highest version (of equal ones, the larger value)."""
    return entries.groupBy(key).agg(F.max_by(value, F.struct(version, value)).alias(value), F.max(version).alias(version))


def without_hosts(servers: DataFrame, connection: str, hosts: DataFrame) -> DataFrame:
    """Servers whose connection holds none of the hosts' names. hosts: host; few, as a configuration lists them."""
    return servers.join(hosts, F.contains(F.col(connection), F.col("host")), "left_anti")
