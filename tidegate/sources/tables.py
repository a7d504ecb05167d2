"""Parquet tables, the registry of servers, and the data plane's tables as they follow from the test data."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, path: str, mode: str = "overwrite", codec: str = "zstd") -> DataFrame:
    """Written as Parquet and read again."""
    df.write.mode(mode).option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def on_disk(df: DataFrame) -> DataFrame:
    """Kept on the executors' disks from its first use on, until ``unpersist``; what is lost with one is computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


def registered(servers: DataFrame, dc: str, cluster: str | None, most: int, excluded: list[str]) -> DataFrame:
    """The first ``most`` servers of a data centre and cluster (None: its first one), without the excluded hosts'."""
    own = servers.where(F.col("dc") == dc)
    if cluster is None:
        own = own.join(F.broadcast(own.agg(F.min("cluster").alias("cluster"))), "cluster", "left_semi")
    else:
        own = own.where(F.col("cluster") == cluster)
    for host in excluded:
        own = own.where(~F.contains("connection", F.lit(host)))
    return own.orderBy("server_id").limit(most)


def looked_up(servers: DataFrame, ids: list[int]) -> DataFrame:
    return servers.where(F.col("server_id").isin(ids))


#: The derived tables in SQL that Spark and DuckDB read alike. Window order names enough columns to be unique.
#: Map task 9 never commits and task 5 not its attempt 2, so their partitions wait: 7 has blocks of task 9 alone, 0 to 3 of
#: one of the two besides others, 4 to 6 of neither. Partitions so are not started, not available and readable at any size.
P = """CASE WHEN l_suppkey % 17 = 9 THEN CASE WHEN l_linenumber % 2 = 0 THEN CAST(7 AS BIGINT) ELSE l_orderkey % 3 END
  WHEN l_suppkey % 17 = 5 THEN l_orderkey % 4 ELSE l_orderkey % 7 END"""
DERIVED = {
    "blocks": f"""SELECT l_suppkey % 17 AS map_id, CAST(l_linenumber % 3 AS BIGINT) AS attempt, {P} AS p,
  CASE WHEN l_linenumber = 7 THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) * 8 END AS len, l_orderkey, l_linenumber, l_partkey,
  CAST(row_number() OVER (PARTITION BY l_suppkey % 17, l_linenumber % 3, {P}
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT) AS seq
FROM lineitem""",
    "commits": """SELECT o_custkey % 17 AS map_id, o_orderkey % 3 AS attempt, max(o_orderdate) AS ts FROM orders
WHERE NOT (o_custkey % 17 = 5 AND o_orderkey % 3 = 2) AND o_custkey % 17 <> 9 GROUP BY 1, 2""",
    "servers": """SELECT s_suppkey AS server_id, concat('v', CAST(s_suppkey % 3 AS STRING)) AS version,
  concat('host', CAST(s_suppkey AS STRING), ':', CAST(10000 + s_suppkey % 7 AS STRING)) AS connection, r_name AS dc, n_name AS cluster,
  CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE CAST(floor(abs(s_acctbal)) AS BIGINT) % 3000 END AS latency, s_suppkey % 13 AS conns
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "app_events": """SELECT user_id % 11 AS app, user_id % 40 AS channel, event_id, ts, event_type, CAST(floor(value) AS BIGINT) AS n_bytes FROM events""",
    # which apps have early commits (0, 4, ...), deletions (6, 13, 20), corruption (5, 11, 17), other numbers of partitions (4,
    # 9, ...) or of splits (3, 8, ...) and no stage at all (22) follows from the app, so that all cases occur at any size
    "state_log": """SELECT event_id AS seq, ts, user_id % 23 AS app, event_id % 5 AS shuffle,
  CASE WHEN event_id = opening AND user_id % 23 % 4 <> 0 AND user_id % 23 <> 22 THEN 'stage'
    WHEN event_type = 'view' AND user_id % 23 <> 22 THEN 'stage'
    WHEN event_type = 'error' AND user_id % 23 % 6 = 5 AND event_id % 4 = 0 THEN 'corrupt'
    WHEN event_type = 'click' AND user_id % 23 % 7 = 6 AND event_id % 3 = 0 THEN 'delete' ELSE 'commit' END AS kind,
  CASE WHEN user_id % 23 % 5 = 4 AND event_id % 5 = 2 AND event_id % 3 = 0 THEN CAST(9 AS BIGINT) ELSE CAST(8 AS BIGINT) END AS num_partitions,
  event_id % 4 AS start, CASE WHEN user_id % 23 % 5 = 3 AND event_id % 5 = 1 THEN 1 + event_id % 2 ELSE 1 + event_id % 5 % 2 END AS splits, event_id % 20 AS attempt
FROM events JOIN (SELECT user_id % 23 AS a, event_id % 5 AS s, min(event_id) AS opening FROM events GROUP BY 1, 2) f ON user_id % 23 = a AND event_id % 5 = s""",
}
NEEDS = {"blocks": ["lineitem"], "commits": ["orders"], "servers": ["supplier", "nation", "region"], "app_events": ["events"], "state_log": ["events"]}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, by the SQL above over the Parquet tables it needs."""
    return spark.sql(_placed(DERIVED[name], NEEDS[name]), **{t: table(spark, sf_dir, t) for t in NEEDS[name]})


def _placed(sql: str, needs: list[str]) -> str:
    for t in needs:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t} ", f"{word} {{{t}}} {t} ").replace(f"{word} {t}\n", f"{word} {{{t}}} {t}\n")
            sql = sql[: -len(t)] + f"{{{t}}} {t}" if sql.endswith(f"{word} {t}") else sql
    return sql


def with_tables(names: list[str], sql: str) -> str:
    """DuckDB SQL over derived tables."""
    return "WITH " + ", ".join(f"{n} AS ({DERIVED[n].replace('AS STRING', 'AS VARCHAR')})" for n in names) + "\n" + sql
