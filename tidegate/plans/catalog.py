"""One entry a query: its name, its DataFrame and the SQL that gives the same rows.

Queries named after the survey's sections apply the operators of this library to the data plane's tables
(``tidegate.sources.tables``). Where there is no SQL, the result is checked by tests alone.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import scalars as fn
from tidegate.operators import buffers, commits, keyed, placement, replicas, statelog
from tidegate.sources import generated
from tidegate.sources.tables import derived, looked_up, registered, table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-25 00:00:00"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Registers a query. needs: derived tables that its SQL reads."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_tables(list(needs), sql) if needs else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


# ------------------------------------------------------------------ the flagship

FLAGSHIP = """, w AS (SELECT map_id, max(attempt) AS attempt FROM commits GROUP BY 1),
live AS (SELECT b.p, count(*) AS n_blocks, CAST(sum(len) AS BIGINT) AS n_bytes FROM blocks b JOIN w USING (map_id, attempt) WHERE len > 0 GROUP BY 1),
want AS (SELECT DISTINCT p, map_id FROM blocks), st AS (
  SELECT p, count(*) AS wanted, count(*) - count(w.map_id) AS missing FROM want LEFT JOIN w USING (map_id) GROUP BY 1)
SELECT st.p, n_blocks, n_bytes, wanted, missing, CASE WHEN missing = 0 THEN 'ok' WHEN missing = wanted THEN 'not_started' ELSE 'not_available' END AS status
FROM st LEFT JOIN live USING (p)"""


def _after_with(names: list[str], sql: str) -> str:
    """SQL that goes on with more common tables after the derived ones."""
    return with_tables(names, "").rstrip() + sql


@query("flagship_readable_partitions", _after_with(["blocks", "commits"], FLAGSHIP))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each partition: rows and bytes of the winning attempts, and whether all its map tasks have committed."""
    blocks, won = derived(spark, sf_dir, "blocks"), commits.winners(derived(spark, sf_dir, "commits"))
    live = commits.live(blocks.where("len > 0"), won, ["map_id", "attempt"]).groupBy("p").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("len").alias("n_bytes"))
    state = commits.availability(blocks.select("p", "map_id").distinct(), won, ["p"], ["map_id"])
    return state.join(live, "p", "left").select("p", "n_blocks", "n_bytes", "wanted", "missing", "status")


# ------------------------------------------------------------------ A: sources


@query("a1_parquet_scan", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def _(spark, d):
    return lines(spark, d).where("l_shipdate < timestamp_ntz'1998-01-01'").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))


@query("a3_range_source", "SELECT i % 2 AS k, count(*) AS n, CAST(sum(i) AS BIGINT) AS s FROM range(1, 101) t(i) GROUP BY 1")
def _(spark, d):
    return generated.numbers(spark, 1, 101, 3).groupBy((F.col("id") % 2).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))


@query("a4_key_values", """SELECT i AS id, repeat(chr(CAST(97 + (i * 7) % 26 AS INT)), CAST(1 + (i * 3) % 20 AS INT)) AS key,
  repeat(chr(CAST(97 + (i * 11) % 26 AS INT)), CAST(1 + (i * 5) % 20 AS INT)) AS value FROM range(0, 1000) t(i)""")
def _(spark, d):
    return generated.key_values(spark, 1000, 10)


@query("a5_coalesced", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")
def _(spark, d):
    return table(spark, d, "orders").coalesce(2).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


@query("a10_state_log_scan", _after_with(["state_log"], """, f AS (SELECT strftime(ts, '%Y%m%d') AS file, seq, seq % 331 = 17 AS bad FROM state_log), b AS (SELECT file, min(seq) AS first FROM f WHERE bad GROUP BY 1)
SELECT f.file, count(*) AS n, max(seq) AS last FROM f LEFT JOIN b USING (file) WHERE first IS NULL OR seq < first GROUP BY 1"""))
def _(spark, d):
    log = derived(spark, d, "state_log").withColumn("file", F.date_format("ts", "yyyyMMdd")).withColumn("bad", F.col("seq") % 331 == 17)
    return statelog.before_first_bad(log, "file", "seq", "bad").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


@query("a11_registry", "SELECT server_id, version, connection FROM servers WHERE dc = 'ASIA' AND connection NOT LIKE '%host1%' AND cluster = (SELECT min(cluster) FROM servers WHERE dc = 'ASIA') ORDER BY server_id LIMIT 5", ("servers",))
def _(spark, d):
    return registered(derived(spark, d, "servers"), "ASIA", None, 5, ["host1"]).select("server_id", "version", "connection")


@query("a11_lookup", "SELECT server_id, connection FROM servers WHERE server_id IN (3, 7, 500000)", ("servers",))
def _(spark, d):
    return looked_up(derived(spark, d, "servers"), [3, 7, 500000]).select("server_id", "connection")


# ------------------------------------------------------------------ B: projections and filters


@query("b1_projection", "SELECT l_orderkey // 2 AS k, l_orderkey * 2 AS v, l_linenumber FROM lineitem")
def _(spark, d):
    return lines(spark, d).select(F.expr("l_orderkey div 2").alias("k"), (F.col("l_orderkey") * 2).alias("v"), "l_linenumber")


@query("b2_map_partitions", "SELECT l_orderkey, l_orderkey % 7 * 10 + l_linenumber AS v FROM lineitem")
def _(spark, d):
    def run(frames):
        for f in frames:
            yield f.assign(v=f.l_orderkey % 7 * 10 + f.l_linenumber)[["l_orderkey", "v"]]

    return lines(spark, d).select("l_orderkey", "l_linenumber").mapInPandas(run, "l_orderkey long, v long")


@query("b3_live_blocks", "SELECT b.map_id, b.attempt, count(*) AS n FROM blocks b WHERE EXISTS (SELECT 1 FROM commits c WHERE c.map_id = b.map_id AND c.attempt = b.attempt) GROUP BY 1, 2", ("blocks", "commits"))
def _(spark, d):
    return commits.live(derived(spark, d, "blocks"), derived(spark, d, "commits"), ["map_id", "attempt"]).groupBy("map_id", "attempt").agg(F.count(F.lit(1)).alias("n"))


@query("b3_stale_blocks", "SELECT b.map_id, b.attempt, count(*) AS n FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM commits c WHERE c.map_id = b.map_id AND c.attempt = b.attempt) GROUP BY 1, 2", ("blocks", "commits"))
def _(spark, d):
    return commits.stale(derived(spark, d, "blocks"), derived(spark, d, "commits"), ["map_id", "attempt"]).groupBy("map_id", "attempt").agg(F.count(F.lit(1)).alias("n"))


@query("b4_non_empty_blocks", "SELECT p, count(*) AS n, CAST(sum(len) AS BIGINT) AS n_bytes FROM blocks WHERE len > 0 GROUP BY 1", ("blocks",))
def _(spark, d):
    return derived(spark, d, "blocks").where("len > 0").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("n_bytes"))


FILES = "SELECT p, map_id, CAST(sum(len) AS BIGINT) AS recorded, CASE WHEN map_id = 3 THEN NULL WHEN map_id = 4 THEN 0 WHEN map_id = 6 THEN CAST(sum(len) AS BIGINT) - 1 ELSE CAST(sum(len) AS BIGINT) END AS actual FROM blocks GROUP BY 1, 2"


@query("b5_file_states", f"SELECT p, map_id, CASE WHEN actual IS NULL THEN 'missing' WHEN actual = 0 THEN 'empty' WHEN actual < recorded THEN 'short' ELSE 'ok' END AS state FROM ({FILES})", ("blocks",))
def _(spark, d):
    files = derived(spark, d, "blocks").groupBy("p", "map_id").agg(F.sum("len").alias("recorded"))
    actual = F.when(F.col("map_id") == 4, 0).when(F.col("map_id") == 6, F.col("recorded") - 1).when(F.col("map_id") != 3, F.col("recorded"))
    return files.select("p", "map_id", commits.file_state(F.col("recorded"), actual).alias("state"))


@query("b6_excluded_hosts", "SELECT server_id FROM servers WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('host1'), ('host22:')) h(host) WHERE contains(connection, host))", ("servers",))
def _(spark, d):
    hosts = spark.createDataFrame([("host1",), ("host22:",)], "host string")
    return placement.without_hosts(derived(spark, d, "servers"), "connection", hosts).select("server_id")


@query("b7_reachable", "SELECT server_id, latency FROM servers WHERE latency IS NOT NULL", ("servers",))
def _(spark, d):
    return derived(spark, d, "servers").where("latency IS NOT NULL").select("server_id", "latency")


@query("b8_partition_range", "SELECT p, count(*) AS n FROM blocks WHERE p >= 2 AND p < 5 GROUP BY 1", ("blocks",))
def _(spark, d):
    return keyed.in_range(derived(spark, d, "blocks"), "p", 2, 5).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("b8_empty_range", "SELECT p, count(*) AS n FROM blocks WHERE p = 4 GROUP BY 1", ("blocks",))
def _(spark, d):
    return keyed.in_range(derived(spark, d, "blocks"), "p", 4, 4).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ C: exchange


@query("c1_modulus_placement", "SELECT o_custkey % 8 AS p, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    placed = keyed.placed_by_modulus(table(spark, d, "orders").select("o_custkey"), "o_custkey", 8)
    return placed.groupBy(F.spark_partition_id().cast("long").alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("c1_hash_colocation", "SELECT count(DISTINCT o_custkey) AS n_keys, CAST(0 AS BIGINT) AS split_keys FROM orders")
def _(spark, d):
    placed = keyed.by_hash(table(spark, d, "orders").select("o_custkey"), ["o_custkey"], 8).withColumn("p", F.spark_partition_id())
    own = placed.groupBy("o_custkey").agg(F.count_distinct("p").alias("n"))
    return own.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("split_keys"))


@query("c2_round_robin", "SELECT count(*) AS n, CAST(4 AS BIGINT) AS parts, true AS even FROM orders")
def _(spark, d):
    own = keyed.round_robin(table(spark, d, "orders").select("o_orderkey"), 4).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("k"))
    return own.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("parts"), (F.max("k") - F.min("k") <= 4 * 8).alias("even"))


@query("c3_range_sorted", "SELECT o_custkey, o_orderkey FROM orders")
def _(spark, d):
    return keyed.sorted_ranges(table(spark, d, "orders").select("o_custkey", "o_orderkey"), F.col("o_custkey").desc(), 5)


@query("c3_ranges_descend", "SELECT CAST(5 AS BIGINT) AS parts, CAST(0 AS BIGINT) AS overlaps, count(*) AS n FROM orders")
def _(spark, d):
    own = keyed.sorted_ranges(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey").desc(), 5).groupBy(F.spark_partition_id().alias("p")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.count(F.lit(1)).alias("k"))
    # one row a partition; neighbours tell whether the whole descends
    rows = own.agg(F.array_sort(F.collect_list(F.struct("p", "a", "b", "k"))).alias("r"))
    return rows.selectExpr("cast(size(r) as long) AS parts", "cast(size(filter(r, (x, i) -> i > 0 AND x.b > r[greatest(i - 1, 0)].a)) as long) AS overlaps", "aggregate(r, 0L, (s, x) -> s + x.k) AS n")


@query("c4_one_partition", "SELECT CAST(0 AS BIGINT) AS p, count(*) AS n FROM orders")
def _(spark, d):
    return keyed.by_modulus(table(spark, d, "orders").select("o_custkey"), "o_custkey", 1).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("c5_no_map_tasks", "SELECT CAST(1 AS BIGINT) AS k, CAST(1 AS BIGINT) AS v WHERE false")
def _(spark, d):
    return generated.empty(spark, "k long, v long").groupBy("k").agg(F.sum("v").alias("v"))


@query("c6_empty_partitions", "SELECT i AS p, coalesce(n_rows, 0) AS n_rows FROM range(0, 8) t(i) LEFT JOIN (SELECT (o_custkey * 2) % 8 AS p, count(*) AS n_rows FROM orders GROUP BY 1) ON i = p")
def _(spark, d):
    return keyed.rows_by_partition(table(spark, d, "orders").select(F.expr("(o_custkey * 2) % 8").alias("p")), "p", 8)


@query("c7_partition_lengths", "SELECT p, CAST(sum(l) AS BIGINT) AS bytes, greatest(CAST(sum(l) AS BIGINT), 1) AS reported FROM (SELECT p, CASE WHEN p = 3 THEN 0 ELSE len END AS l FROM blocks) GROUP BY 1", ("blocks",))
def _(spark, d):
    return keyed.partition_lengths(derived(spark, d, "blocks").withColumn("l", F.when(F.col("p") == 3, 0).otherwise(F.col("len"))), "p", "l")


@query("c8_conflicting_counts", "SELECT app, shuffle, count(DISTINCT num_partitions) AS n_values FROM state_log WHERE kind = 'stage' GROUP BY 1, 2 HAVING count(DISTINCT num_partitions) > 1", ("state_log",))
def _(spark, d):
    return keyed.conflicting(derived(spark, d, "state_log").where("kind = 'stage'"), ["app", "shuffle"], "num_partitions")


# ------------------------------------------------------------------ D: aggregates


@query("d1_reduce_by_key", "SELECT l_orderkey % 97 AS k, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def _(spark, d):
    return keyed.reduce_by_key(lines(spark, d).select((F.col("l_orderkey") % 97).alias("k"), "l_linenumber"), ["k"], s=F.sum("l_linenumber"))


@query("d2_fold_by_key", "SELECT l_partkey AS k, CAST(coalesce(sum(CASE WHEN l_linenumber > 6 THEN NULL ELSE l_linenumber END), 0) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def _(spark, d):
    return keyed.fold_by_key(lines(spark, d).select(F.col("l_partkey").alias("k"), F.expr("CASE WHEN l_linenumber <= 6 THEN l_linenumber END").alias("v")), ["k"], "v")


@query("d3_group_by_key", "SELECT o_custkey AS k, array_to_string(list_sort(list(o_orderkey)), ',') AS vs FROM orders GROUP BY 1")
def _(spark, d):
    out = keyed.group_by_key(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), ["k"], "o_orderkey")
    return out.select("k", F.array_join(F.transform("vs", lambda x: x.cast("string")), ",").alias("vs"))


@query("d4_combine_to_list", "SELECT o_custkey AS k, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY 1")
def _(spark, d):
    out = keyed.group_by_key(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), ["k"], "o_orderkey")
    return out.select("k", F.size("vs").cast("long").alias("n"), F.aggregate("vs", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))


@query("d5_combine_to_set", "SELECT l_suppkey AS k, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS vs FROM lineitem GROUP BY 1")
def _(spark, d):
    out = keyed.combine_to_set(lines(spark, d).select(F.col("l_suppkey").alias("k"), "l_linenumber"), ["k"], "l_linenumber")
    return out.select("k", F.array_join(F.transform("vs", lambda x: x.cast("string")), ",").alias("vs"))


@query("d6_custom_aggregate", "SELECT l_suppkey AS k, CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(max(l_linenumber) AS BIGINT) AS most, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    def create(g):
        return pd.DataFrame({"s": g.v.sum(min_count=1), "most": g.v.max(), "n": g.v.size()})

    def merge(g):
        return pd.DataFrame({"s": g.s.sum(min_count=1), "most": g.most.max(), "n": g.n.sum()})

    rows = lines(spark, d).select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("v"))
    return keyed.aggregate_groups(rows, ["k"], create, merge, "s long, most long, n long")


@query("d7_two_level_combine", "SELECT l_partkey AS k, CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return keyed.two_level(lines(spark, d).select(F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 17).alias("task"), "l_linenumber"), ["k"], "task", "l_linenumber")


@query("d8_raw_combine", "SELECT l_returnflag AS k, count(*) AS n, min(l_linenumber) AS least FROM lineitem GROUP BY 1")
def _(spark, d):
    return lines(spark, d).groupBy(F.col("l_returnflag").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("least"))


#: The order of a map task's records, in one number: attempts one after another, of each the partitions.
ORDER = "(attempt * 8 + p) * 1000000000 + seq"
D9 = f"""SELECT map_id, CAST(floor((place - 1) / 50) AS BIGINT) AS epoch, p, l_partkey % 20 AS k, CAST(sum(len) AS BIGINT) AS combined, count(*) AS records
FROM (SELECT map_id, p, len, l_partkey, row_number() OVER (PARTITION BY map_id ORDER BY {ORDER}) AS place FROM blocks) GROUP BY 1, 2, 3, 4"""
D9_SIZE = f"""SELECT map_id, CAST(floor((greatest(total, 1) - 1) / 20000) AS BIGINT) AS epoch, p, l_partkey % 20 AS k, CAST(sum(len) AS BIGINT) AS combined, count(*) AS records
FROM (SELECT map_id, p, len, l_partkey, sum(len) OVER (PARTITION BY map_id ORDER BY {ORDER}) AS total FROM blocks) GROUP BY 1, 2, 3, 4"""


def _combined(spark, d, every, size=None):
    rows = derived(spark, d, "blocks").selectExpr("map_id", "p", "len", "l_partkey % 20 AS k", f"{ORDER} AS o")
    return keyed.best_effort_combine(keyed.flushes(rows, "map_id", "o", 1_000_000_000, every, size), "map_id", "epoch", ["p", "k"], "len")


@query("d9_best_effort_combine", D9, ("blocks",))
def _(spark, d):
    return _combined(spark, d, 50)


@query("d9_combine_by_size", D9_SIZE, ("blocks",))
def _(spark, d):
    """Flushed whenever a task has taken 20,000 bytes more."""
    return _combined(spark, d, 20000, "len")


@query("d10_no_combine", "SELECT map_id, count(*) AS written FROM blocks GROUP BY 1", ("blocks",))
def _(spark, d):
    return derived(spark, d, "blocks").select("map_id", F.array("len").alias("combined")).groupBy("map_id").agg(F.count("combined").alias("written"))


@query("d11_reduction_factor", f"SELECT map_id, CASE WHEN sum(records) = 0 THEN 0.0 ELSE round(1 - CAST(count(*) AS DOUBLE) / CAST(sum(records) AS DOUBLE), 6) END AS factor FROM ({D9}) GROUP BY 1", ("blocks",))
def _(spark, d):
    own = _combined(spark, d, 50).groupBy("map_id").agg(F.sum("records").alias("r"), F.count(F.lit(1)).alias("w"))
    return own.select("map_id", keyed.reduction_factor(F.col("r"), F.col("w")).alias("factor"))


@query("d12_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def _(spark, d):
    return lines(spark, d).groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.sum("l_linenumber").alias("s"))


@query("d12_distinct_strings", "SELECT i % 2 AS k, count(DISTINCT repeat('a', CAST(i AS INT))) AS n FROM range(1, 1001) t(i) GROUP BY 1")
def _(spark, d):
    return generated.numbers(spark, 1, 1001, 3).groupBy((F.col("id") % 2).alias("k")).agg(F.count_distinct(fn.repeated("a", F.col("id"))).alias("n"))


@query("d13_min_max_sum", "SELECT c_mktsegment, min(c_name) AS least, max(c_name) AS most, CAST(sum(c_nationkey) AS BIGINT) AS s FROM customer GROUP BY 1")
def _(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_name").alias("least"), F.max("c_name").alias("most"), F.sum("c_nationkey").alias("s"))


@query("d14_conservation", "SELECT count(*) AS n_in, CAST(sum(len) AS BIGINT) AS bytes_in, count(*) AS n_out, CAST(sum(len) AS BIGINT) AS bytes_out FROM blocks", ("blocks",))
def _(spark, d):
    blocks = derived(spark, d, "blocks").select("map_id", "len")
    before = blocks.agg(F.count(F.lit(1)).alias("n_in"), F.sum("len").alias("bytes_in"))
    moved = blocks.repartition(8, "map_id").groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("b"))
    return before.join(moved.agg(F.sum("n").alias("n_out"), F.sum("b").alias("bytes_out")))


@query("d15_latest_attempt", "SELECT map_id, max(attempt) AS attempt FROM commits GROUP BY 1", ("commits",))
def _(spark, d):
    return keyed.latest(derived(spark, d, "commits"), ["map_id"], "attempt")


@query("d16_one_value", "SELECT app, count(DISTINCT num_partitions) = 1 AS consistent FROM state_log GROUP BY 1", ("state_log",))
def _(spark, d):
    return keyed.one_value(derived(spark, d, "state_log"), ["app"], "num_partitions")


@query("d17_longest_per_file", "SELECT p, map_id, max(len) AS length FROM blocks GROUP BY 1, 2", ("blocks",))
def _(spark, d):
    return derived(spark, d, "blocks").groupBy("p", "map_id").agg(F.max("len").alias("length"))


@query("d18_persisted_bytes", "SELECT map_id, CAST(sum(len) AS BIGINT) AS n_bytes FROM blocks GROUP BY 1", ("blocks",))
def _(spark, d):
    return derived(spark, d, "blocks").groupBy("map_id").agg(F.sum("len").alias("n_bytes"))


@query("d19_moving_average", "SELECT event_id, CAST(floor(avg(n_bytes) OVER (PARTITION BY app ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + 0.5) AS BIGINT) AS average FROM app_events", ("app_events",))
def _(spark, d):
    return keyed.moving_average(derived(spark, d, "app_events"), ["app"], "event_id", "n_bytes", 10, 1_000_000).select("event_id", "average")


@query("d20_rates", "SELECT app, time_bucket(INTERVAL '1 hour', ts) AS start, CAST(sum(n_bytes) AS BIGINT) AS total, round(CAST(sum(n_bytes) AS DOUBLE) / 3600, 6) AS rate FROM app_events GROUP BY 1, 2", ("app_events",))
def _(spark, d):
    return statelog.rates(derived(spark, d, "app_events"), "ts", "n_bytes", ["app"])


@query("d20_overall_rate", "SELECT app, round(CAST(sum(n_bytes) AS DOUBLE) / date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))), 6) AS rate FROM app_events GROUP BY 1", ("app_events",))
def _(spark, d):
    span = F.expr("timestampdiff(SECOND, date_trunc('second', min(ts)), date_trunc('second', max(ts)))")
    return derived(spark, d, "app_events").groupBy("app").agg(F.round(F.sum("n_bytes") / span, 6).alias("rate"))


# ------------------------------------------------------------------ E: order, sets, functions


@query("e1_total_order", "SELECT l_suppkey AS k, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def _(spark, d):
    return lines(spark, d).groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_linenumber").alias("s")).orderBy("s", "k")


@query("e1_order_check", "SELECT map_id, count(*) FILTER (WHERE before > len) AS inversions FROM (SELECT map_id, len, lag(len) OVER (PARTITION BY map_id ORDER BY l_orderkey, attempt, p, seq) AS before FROM blocks) GROUP BY 1", ("blocks",))
def _(spark, d):
    rows = derived(spark, d, "blocks").withColumn("o", F.struct("l_orderkey", "attempt", "p", "seq"))
    return keyed.is_sorted(rows, ["map_id"], "o", "len")


@query("e2_sorted_within", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem")
def _(spark, d):
    return keyed.by_hash(lines(spark, d).select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], 8).sortWithinPartitions("l_suppkey", "l_orderkey")


@query("e3_null_groups", "SELECT k, min(v) AS least, max(v) AS most, row_number() OVER (ORDER BY k NULLS FIRST) AS place FROM (VALUES (NULL, 1), (NULL, 2), ('', 3), ('', 4), ('str1', 5), ('str1', 6)) t(k, v) GROUP BY k")
def _(spark, d):
    return spark.sql("""SELECT k, min(v) AS least, max(v) AS most, CAST(row_number() OVER (ORDER BY k NULLS FIRST) AS BIGINT) AS place
        FROM VALUES (NULL, 1), (NULL, 2), ('', 3), ('', 4), ('str1', 5), ('str1', 6) AS t(k, v) GROUP BY 1 ORDER BY 1""")


@query("e4_union_all", "SELECT * FROM (SELECT c_nationkey AS k, c_name AS str FROM customer UNION ALL SELECT 0, '')")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("str")).unionByName(spark.sql("SELECT 0 AS k, '' AS str"))


@query("e5_top_servers", "SELECT server_id, conns FROM servers ORDER BY conns DESC, server_id LIMIT 7", ("servers",))
def _(spark, d):
    return derived(spark, d, "servers").orderBy(F.desc("conns"), "server_id").limit(7).select("server_id", "conns")


@query("e5_top_per_group", "SELECT dc, server_id FROM (SELECT dc, server_id, row_number() OVER (PARTITION BY dc ORDER BY conns, server_id) AS k FROM servers) WHERE k <= 3", ("servers",))
def _(spark, d):
    return keyed.top_per_group(derived(spark, d, "servers"), ["dc"], ["conns", "server_id"], 3).select("dc", "server_id")


@query("e6_distinct", "SELECT DISTINCT map_id, attempt FROM blocks", ("blocks",))
def _(spark, d):
    return derived(spark, d, "blocks").select("map_id", "attempt").distinct()


@query("e6_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return keyed.duplicates(lines(spark, d), ["l_orderkey", "l_linenumber"])


@query("e7_nine_digits", "SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS str FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.nine_digits(F.col("o_orderkey")).alias("str"))


@query("e7_nine_digits_udf", "SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS str FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.nine_digits_udf("o_orderkey").alias("str"))


@query("e8_repeat", "SELECT l_linenumber AS n, repeat('a', l_linenumber) AS str, count(*) AS k FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return lines(spark, d).groupBy(F.col("l_linenumber").alias("n"), fn.repeated("a", F.col("l_linenumber")).alias("str")).agg(F.count(F.lit(1)).alias("k"))


@query("e9_pick", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS pick FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.picked(["x", "y", "z"], F.col("c_custkey")).alias("pick"))


@query("e10_containment", "SELECT p FROM (SELECT DISTINCT p, map_id FROM blocks) w WHERE p NOT IN (SELECT b.p FROM blocks b WHERE b.map_id NOT IN (SELECT map_id FROM commits)) GROUP BY p", ("blocks", "commits"))
def _(spark, d):
    state = commits.availability(derived(spark, d, "blocks").select("p", "map_id").distinct(), derived(spark, d, "commits").select("map_id").distinct(), ["p"], ["map_id"])
    return state.where("status = 'ok'").select("p")


E11 = "SELECT map_id, r.n AS n_read, t.n AS n_taken FROM (SELECT map_id, count(*) AS n FROM blocks WHERE map_id <> 2 GROUP BY 1) r FULL JOIN (SELECT map_id, count(*) AS n FROM blocks WHERE NOT (map_id = 4 AND seq = 1 AND p = 0) AND map_id <> 7 GROUP BY 1) t USING (map_id) WHERE r.n IS DISTINCT FROM t.n"


@query("e11_map_difference", E11, ("blocks",))
def _(spark, d):
    b = derived(spark, d, "blocks")
    count = lambda x: x.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))
    return replicas.count_differences(count(b.where("map_id <> 2")), count(b.where("NOT (map_id = 4 AND seq = 1 AND p = 0) AND map_id <> 7")), ["map_id"])


# ------------------------------------------------------------------ F: placement

SHAPES = "SELECT p_size AS maps, p_size * 3 % 70 + 1 AS parts, p_size % 3 + 1 AS replicas, p_size % 5 AS least FROM part"


def _shapes(spark, d):
    return spark.sql(SHAPES.replace("FROM part", "FROM {part} part"), part=table(spark, d, "part")).distinct()


@query("f1_server_count", f"SELECT DISTINCT maps, parts, replicas, least, CAST(greatest(greatest(least(50, ceil(greatest(maps, parts) / 20.0), parts), 1) * replicas, least) AS BIGINT) AS servers FROM ({SHAPES})")
def _(spark, d):
    c = F.col
    return _shapes(spark, d).withColumn("servers", placement.server_count(c("maps"), c("parts"), c("replicas"), c("least"), F.lit(50), F.lit(20)))


@query("f2_fanout", f"SELECT DISTINCT maps, parts, replicas, least, CAST(CASE WHEN least > 1 AND floor(maps / replicas) > parts THEN floor(floor(maps / replicas) / parts) ELSE 1 END AS BIGINT) AS fanout FROM ({SHAPES})")
def _(spark, d):
    c = F.col
    return _shapes(spark, d).withColumn("fanout", placement.fanout(c("maps"), c("replicas"), c("parts"), c("least")))


@query("f3_replica_groups", "SELECT dc, group_id, array_to_string(list_sort(list(server_id)), ',') AS members FROM (SELECT dc, server_id, CAST(floor((row_number() OVER (PARTITION BY dc ORDER BY server_id) - 1) / 3) AS BIGINT) AS group_id FROM servers) GROUP BY 1, 2 HAVING count(*) = 3", ("servers",))
def _(spark, d):
    out = placement.replica_groups(derived(spark, d, "servers"), "server_id", 3, ("dc",))
    return out.select("dc", "group_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("f4_partition_groups", "SELECT p, i, (p % 7 + i) % 7 AS group_id FROM range(0, 20) a(p), range(0, 3) b(i)")
def _(spark, d):
    return placement.groups_of_partitions(spark.range(20).toDF("p"), 7, 3).select("p", F.col("i").cast("long").alias("i"), "group_id")


@query("f5_write_routing", "SELECT map_id, attempt, p, (p % 5 + attempt % 2) % 5 AS group_id, p % 5 AS own, count(*) AS n FROM blocks GROUP BY 1, 2, 3", ("blocks",))
def _(spark, d):
    b = derived(spark, d, "blocks").groupBy("map_id", "attempt", "p").agg(F.count(F.lit(1)).alias("n"))
    return b.select("map_id", "attempt", "p", placement.routed_group(F.col("p"), F.col("attempt"), 5, 2).alias("group_id"), placement.routed_group(F.col("p"), F.col("attempt"), 5, 1).alias("own"), "n")


@query("f6_split_routing", "SELECT p, (map_id * 3 + attempt) % 4 AS split, count(*) AS n FROM blocks GROUP BY 1, 2", ("blocks",))
def _(spark, d):
    return derived(spark, d, "blocks").groupBy("p", placement.routed_split(F.col("map_id") * 3 + F.col("attempt"), 4).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("f7_split_count", "SELECT i AS maps, CAST(least(greatest(ceil(i / 800.0), 1), 6) AS BIGINT) AS splits FROM range(0, 10000, 123) t(i)")
def _(spark, d):
    return spark.range(0, 10000, 123).select(F.col("id").alias("maps"), placement.split_count(F.col("id"), F.lit(800), F.lit(1), F.lit(6)).alias("splits"))


@query("f8_candidates", """SELECT dc, server_id, k AS place FROM (SELECT dc, server_id, row_number() OVER (PARTITION BY dc ORDER BY floor(latency / 500), conns, server_id) AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY dc ORDER BY server_id) AS c FROM servers) WHERE c <= 10 AND latency IS NOT NULL) WHERE k <= 5""", ("servers",))
def _(spark, d):
    asked = placement.candidates(derived(spark, d, "servers"), 5, ("dc",))
    return placement.ranked(asked, 5, ("dc",)).select("dc", "server_id", "place")


@query("f9_sample", "SELECT server_id FROM servers ORDER BY md5(concat(server_id, '-42')), server_id LIMIT 10", ("servers",))
def _(spark, d):
    return placement.sampled(derived(spark, d, "servers"), 10, 42).select("server_id")


@query("f10_restarts", "SELECT server_id, version AS was, CASE WHEN server_id % 4 <> 0 THEN concat(version, CASE WHEN server_id % 9 = 0 THEN 'x' ELSE '' END) END AS now FROM servers WHERE server_id % 4 = 0 OR server_id % 9 = 0", ("servers",))
def _(spark, d):
    old = derived(spark, d, "servers").select("server_id", "version")
    new = old.where("server_id % 4 <> 0").withColumn("version", F.when(F.col("server_id") % 9 == 0, F.concat("version", F.lit("x"))).otherwise(F.col("version")))
    return placement.changed(old, new, "server_id", "version")


@query("f11_newest", "SELECT app, max(seq) AS seq, max_by(attempt, seq) AS attempt FROM state_log GROUP BY 1", ("state_log",))
def _(spark, d):
    return placement.newest(derived(spark, d, "state_log"), "app", "seq", "attempt").select("app", "seq", "attempt")


@query("f12_writer_threads", "SELECT i AS servers, CAST(least(ceil(i / 8.0), 4) AS BIGINT) AS threads, i % CAST(greatest(least(ceil(i / 8.0), 4), 1) AS BIGINT) AS own FROM range(1, 60) t(i)")
def _(spark, d):
    n = placement.writer_threads(F.col("id"), F.lit(4))
    return spark.range(1, 60).select(F.col("id").alias("servers"), n.alias("threads"), (F.col("id") % F.greatest(n, F.lit(1))).alias("own"))


# ------------------------------------------------------------------ G: blocks


#: One record of every task a step: sizes and counts of the open buffers, and those that leave.
G1 = """, r AS (SELECT map_id AS task, p, len, row_number() OVER (PARTITION BY map_id ORDER BY (attempt * 1000000 + seq) * 8 + p) AS i FROM blocks),
a AS (SELECT task, i, p, list_transform(range(0, 8), lambda k: CASE WHEN k = p THEN len ELSE 0 END) AS sizes, list_transform(range(0, 8), lambda k: CASE WHEN k = p THEN 1 ELSE 0 END) AS counts FROM r),
f AS (
  SELECT DISTINCT task, CAST(0 AS BIGINT) AS i, list_transform(range(0, 8), lambda k: CAST(0 AS BIGINT)) AS sizes, list_transform(range(0, 8), lambda k: CAST(0 AS BIGINT)) AS counts,
    list_transform(range(0, 8), lambda k: CAST(0 AS BIGINT)) AS gone_sizes, list_transform(range(0, 8), lambda k: CAST(0 AS BIGINT)) AS gone_counts FROM r
  UNION ALL
  SELECT task, i, list_transform(s, lambda x, k: CASE WHEN whole OR (full_one AND k = p + 1) THEN 0 ELSE x END), list_transform(c, lambda x, k: CASE WHEN whole OR (full_one AND k = p + 1) THEN 0 ELSE x END),
    list_transform(s, lambda x, k: CASE WHEN whole OR (full_one AND k = p + 1) THEN x ELSE 0 END), list_transform(c, lambda x, k: CASE WHEN whole OR (full_one AND k = p + 1) THEN x ELSE 0 END)
  FROM (SELECT *, s[p + 1] >= 2048 AS full_one, s[p + 1] < 2048 AND list_sum(s) >= 12288 AS whole FROM (
    SELECT f.task, a.i, a.p, list_transform(f.sizes, lambda x, k: CAST(x + a.sizes[k] AS BIGINT)) AS s, list_transform(f.counts, lambda x, k: CAST(x + a.counts[k] AS BIGINT)) AS c
    FROM f JOIN a ON a.task = f.task AND a.i = f.i + 1))
), o AS (
  SELECT task, i, gone_sizes AS s, gone_counts AS c FROM f UNION ALL SELECT task, i + 1, sizes, counts FROM f WHERE i = (SELECT max(r.i) FROM r WHERE r.task = f.task)
)
SELECT task, CAST(k - 1 AS BIGINT) AS p, row_number() OVER (PARTITION BY task ORDER BY i, k) - 1 AS block, c[k] AS n_records, s[k] AS bytes FROM o, range(1, 9) t(k) WHERE c[k] > 0"""


@query("g1_packed_blocks", _after_with(["blocks"], G1).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    """Buffers of 2 KiB and a spill at 12 KiB, folded in each map task."""
    return buffers.pack_blocks(derived(spark, d, "blocks"), "map_id", "p", "(attempt * 1000000 + seq) * 8 + p", "len", 2048, 12288)


@query("g3_bytes_conserved", "SELECT map_id AS task, p, count(*) AS n_records, CAST(sum(len) AS BIGINT) AS bytes FROM blocks GROUP BY 1, 2", ("blocks",))
def _(spark, d):
    out = QUERIES["g1_packed_blocks"](spark, d)
    return out.groupBy("task", "p").agg(F.sum("n_records").alias("n_records"), F.sum("bytes").alias("bytes"))


@query("g5_sorted_flush", "SELECT p, map_id, CAST(sum(len) AS BIGINT) AS bytes FROM blocks GROUP BY 1, 2", ("blocks",))
def _(spark, d):
    return derived(spark, d, "blocks").groupBy("p", "map_id").agg(F.sum("len").alias("bytes")).sortWithinPartitions("p")


@query("g7_verified_blocks", "SELECT count(*) AS n, count(*) FILTER (WHERE l_orderkey % 1000 = 7) AS bad FROM lineitem")
def _(spark, d):
    payload = F.encode(F.concat_ws("|", "l_orderkey", "l_partkey", "l_linenumber"), "UTF-8")
    rows = lines(spark, d).select("l_orderkey", payload.alias("payload"), fn.checksum(payload).alias("recorded"))
    got = F.when(F.col("l_orderkey") % 1000 == 7, F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(fn.checksum(got) != F.col("recorded")).alias("bad"))


@query("g10_write_metrics", "SELECT map_id, attempt, count(*) AS records, CAST(sum(len) AS BIGINT) AS bytes, count(*) FILTER (WHERE len = 0) AS empty, count(DISTINCT p) AS partitions FROM blocks GROUP BY 1, 2", ("blocks",))
def _(spark, d):
    return derived(spark, d, "blocks").groupBy("map_id", "attempt").agg(F.count(F.lit(1)).alias("records"), F.sum("len").alias("bytes"), F.count_if(F.col("len") == 0).alias("empty"), F.count_distinct("p").alias("partitions"))


# ------------------------------------------------------------------ H: commits

MESSAGES = "SELECT user_id % 11 AS app, event_id % 300 AS attempt, ts, CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 2 ELSE 0 END AS rank FROM events"


def _messages(spark, d):
    return spark.sql(MESSAGES.replace("FROM events", "FROM {events} events"), events=table(spark, d, "events"))


@query("h1_attempt_states", f"SELECT app, attempt, CASE max(rank) WHEN 2 THEN 'committed' WHEN 1 THEN 'start_upload' ELSE 'not_started' END AS state, count(*) FILTER (WHERE rank = 1) > 1 AS restarted FROM ({MESSAGES}) GROUP BY 1, 2")
def _(spark, d):
    return commits.attempt_states(_messages(spark, d), ["app", "attempt"])


@query("h2_lazy_start", f"SELECT app, attempt, min(ts) AS started FROM ({MESSAGES}) GROUP BY 1, 2")
def _(spark, d):
    return commits.first_seen(_messages(spark, d), ["app", "attempt"], "ts")


@query("h3_commit_everywhere", "SELECT map_id, attempt, g AS group_id FROM commits, range(0, 4) t(g)", ("commits",))
def _(spark, d):
    return commits.to_every_group(derived(spark, d, "commits").select("map_id", "attempt"), 4)


@query("h5_empty_tasks_commit", "SELECT c.map_id, c.attempt, count(b.p) AS n_blocks FROM commits c LEFT JOIN (SELECT * FROM blocks WHERE map_id <> 1) b ON b.map_id = c.map_id AND b.attempt = c.attempt GROUP BY 1, 2", ("commits", "blocks"))
def _(spark, d):
    b = derived(spark, d, "blocks").where("map_id <> 1").groupBy("map_id", "attempt").agg(F.count(F.lit(1)).alias("n"))
    return derived(spark, d, "commits").join(b, ["map_id", "attempt"], "left").select("map_id", "attempt", F.coalesce("n", F.lit(0)).alias("n_blocks"))


H6 = "SELECT w.p, count(*) AS wanted, count(*) - count(c.map_id) AS missing, CASE WHEN count(*) = count(c.map_id) THEN 'ok' WHEN count(c.map_id) = 0 THEN 'not_started' ELSE 'not_available' END AS status FROM (SELECT DISTINCT p, map_id, attempt FROM blocks) w LEFT JOIN commits c ON c.map_id = w.map_id AND c.attempt = w.attempt GROUP BY 1"


@query("h6_availability", H6, ("blocks", "commits"))
def _(spark, d):
    fetch = derived(spark, d, "blocks").select("p", "map_id", "attempt").distinct()
    return commits.availability(fetch, derived(spark, d, "commits"), ["p"], ["map_id", "attempt"])


@query("h7_missing_attempts", "SELECT DISTINCT map_id, attempt FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM commits c WHERE c.map_id = b.map_id AND c.attempt = b.attempt)", ("blocks", "commits"))
def _(spark, d):
    return commits.missing(derived(spark, d, "blocks").select("map_id", "attempt").distinct(), derived(spark, d, "commits"), ["map_id", "attempt"])


@query("h8_stage_status", "SELECT app, shuffle, CASE WHEN count(*) FILTER (WHERE kind = 'stage') = 0 THEN 'not_started' WHEN count(*) FILTER (WHERE kind = 'corrupt') > 0 THEN 'corrupted' ELSE 'ok' END AS status FROM state_log GROUP BY 1, 2", ("state_log",))
def _(spark, d):
    return statelog.stage_status(derived(spark, d, "state_log"))


@query("h9_snapshot", "SELECT p, map_id, count(*) AS n, CAST(sum(len) AS BIGINT) AS length FROM blocks b WHERE EXISTS (SELECT 1 FROM commits c WHERE c.map_id = b.map_id AND c.attempt = b.attempt) GROUP BY 1, 2", ("blocks", "commits"))
def _(spark, d):
    return commits.snapshot(derived(spark, d, "blocks"), derived(spark, d, "commits"), ["p", "map_id"], ["map_id", "attempt"], "len")


@query("h10_map_statuses", "SELECT attempt, CASE WHEN count(DISTINCT map_id) <> 16 THEN 'wrong_maps' WHEN max(map_id % 5) + 1 <> 5 THEN 'wrong_servers' ELSE 'ok' END AS verdict FROM commits GROUP BY 1", ("commits",))
def _(spark, d):
    own = derived(spark, d, "commits").groupBy("attempt").agg(F.count_distinct("map_id").alias("m"), (F.max(F.col("map_id") % 5) + 1).alias("s"))
    return own.select("attempt", commits.map_status_verdict(F.col("m"), F.col("s"), 16, 5).alias("verdict"))


@query("h12_stale_counts", "SELECT b.map_id, count(*) FILTER (WHERE b.attempt = w.attempt) AS live, count(*) FILTER (WHERE b.attempt <> w.attempt) AS stale FROM blocks b JOIN (SELECT map_id, max(attempt) AS attempt FROM commits GROUP BY 1) w USING (map_id) GROUP BY 1", ("blocks", "commits"))
def _(spark, d):
    w = commits.winners(derived(spark, d, "commits")).withColumnRenamed("attempt", "won")
    return derived(spark, d, "blocks").join(w, "map_id").groupBy("map_id").agg(F.count_if(F.col("attempt") == F.col("won")).alias("live"), F.count_if(F.col("attempt") != F.col("won")).alias("stale"))


# ------------------------------------------------------------------ I: replicas

#: Every step is sent to three replicas. Replica 0 fails first, then 1 of even groups, then 2 of group 4.
STEPS = """SELECT map_id AS grp, r AS replica, seq * 24 + attempt * 8 + p AS step,
  NOT (r = 0 AND seq = 5 OR r = 1 AND map_id % 2 = 0 AND seq = 9 OR r = 2 AND map_id = 4 AND seq = 12) AS ok FROM blocks"""
I1 = f"""WITH s AS (SELECT grp, replica, step, ok FROM ({STEPS}, (VALUES (0), (1), (2)) t(r))), a AS (
  SELECT *, coalesce(min(CAST(ok AS INT)) OVER (PARTITION BY grp, replica ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS alive FROM s)
SELECT grp, step, count(*) FILTER (WHERE alive) AS used, count(*) FILTER (WHERE alive AND ok) AS took, count(*) FILTER (WHERE alive AND ok) > 0 AS succeeded,
  CASE WHEN count(*) FILTER (WHERE alive AND ok) > 0 THEN 'ok' WHEN count(*) FILTER (WHERE alive) > 0 THEN 'failed' ELSE 'no_replica' END AS status FROM a GROUP BY 1, 2"""


@query("i1_replicated_writes", I1.replace("WITH s AS", with_tables(["blocks"], "").rstrip() + ", s AS", 1))
def _(spark, d):
    steps = STEPS.replace("FROM blocks", "FROM {blocks} LATERAL VIEW explode(array(0, 1, 2)) t AS r")
    return replicas.write_outcomes(spark.sql(steps, blocks=derived(spark, d, "blocks")), "grp", "replica", "step", "ok")


COPIES = "SELECT map_id AS grp, r AS replica, CAST(sum(len) AS BIGINT) + CASE WHEN map_id = 3 AND r = 1 THEN 8 ELSE 0 END AS n_bytes FROM blocks, (VALUES (0), (1), (2)) t(r) GROUP BY 1, 2"


def _copies(spark, d):
    sums = derived(spark, d, "blocks").groupBy(F.col("map_id").alias("grp")).agg(F.sum("len").alias("n_bytes"))
    own = sums.withColumn("replica", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return own.withColumn("n_bytes", F.col("n_bytes") + F.when((F.col("grp") == 3) & (F.col("replica") == 1), 8).otherwise(0))


@query("i2_byte_agreement", f"SELECT grp, min(n_bytes) AS least, max(n_bytes) AS most, count(DISTINCT n_bytes) = 1 AS agree FROM ({COPIES}) GROUP BY 1", ("blocks",))
def _(spark, d):
    return replicas.byte_agreement(_copies(spark, d), "grp", "n_bytes")


@query("i3_read_failover", f"SELECT grp, min(replica) FILTER (WHERE (grp + replica) % 3 <> 0 AND grp <> 8) AS source FROM ({COPIES}) GROUP BY 1", ("blocks",))
def _(spark, d):
    return replicas.first_complete(_copies(spark, d).withColumn("complete", F.expr("(grp + replica) % 3 <> 0 AND grp <> 8")), "grp", "replica", "complete")


@query("i4_resumed_read", "SELECT map_id, attempt, p, seq, CASE WHEN map_id % 2 = 0 AND seq <= 10 + map_id THEN 'first' ELSE 'second' END AS source FROM blocks", ("blocks",))
def _(spark, d):
    b = derived(spark, d, "blocks").select("map_id", "attempt", "p", "seq")
    taken = b.where("map_id % 2 = 0").groupBy("map_id", "attempt", "p").agg(F.max(F.col("map_id") + 10).alias("n"))
    return replicas.resumed(b, b, taken, ["map_id", "attempt", "p"])


@query("i5_content_check", "SELECT map_id, attempt, p, seq, len, 'first' AS side FROM blocks WHERE map_id = 6 AND seq = 2 UNION ALL SELECT map_id, attempt, p, seq, len + 1, 'second' FROM blocks WHERE map_id = 6 AND seq = 2", ("blocks",))
def _(spark, d):
    a = derived(spark, d, "blocks").select("map_id", "attempt", "p", "seq", "len")
    b = a.withColumn("len", F.when((F.col("map_id") == 6) & (F.col("seq") == 2), F.col("len") + 1).otherwise(F.col("len")))
    return replicas.content_differences(a, b, ["map_id", "attempt", "p", "seq"], "len")


@query("i6_groups_in_turn", "SELECT p % 3 AS group_id, map_id, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes FROM blocks GROUP BY 1, 2", ("blocks",))
def _(spark, d):
    counts = derived(spark, d, "blocks").groupBy("p", "map_id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes"))
    own = counts.withColumn("p", F.pmod("p", F.lit(3))).groupBy("p", "map_id").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    return replicas.in_turn(own, "p", 3).select("group_id", "map_id", "n", "bytes")


@query("i7_identity", "SELECT server_id, connection AS was, connection || 'x' AS now FROM servers WHERE server_id % 6 = 1", ("servers",))
def _(spark, d):
    old = derived(spark, d, "servers").select("server_id", "connection")
    new = old.withColumn("connection", F.when(F.col("server_id") % 6 == 1, F.concat("connection", F.lit("x"))).otherwise(F.col("connection")))
    return placement.changed(old, new, "server_id", "connection")


# ------------------------------------------------------------------ J: the state log


@query("j2_rotated_files", "SELECT 'v1_' || strftime(ts, '%Y%m%d%H') AS file, count(*) AS n, min(seq) AS first FROM state_log WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 36 HOURS GROUP BY 1", ("state_log",))
def _(spark, d):
    kept = statelog.retained(derived(spark, d, "state_log"), "ts", NOW)
    return statelog.rotated(kept, "ts").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


J3 = """SELECT app, shuffle, CASE WHEN count(*) FILTER (WHERE kind = 'corrupt') > 0 OR count(DISTINCT num_partitions) FILTER (WHERE kind = 'stage') > 1
    OR count(DISTINCT splits) FILTER (WHERE kind = 'stage') > 1 OR min(seq) FILTER (WHERE kind = 'commit') < min(seq) FILTER (WHERE kind = 'stage') THEN 'corrupted' ELSE 'ok' END AS status,
  count(*) FILTER (WHERE kind = 'commit') AS commits, CAST(max(start + splits) FILTER (WHERE kind = 'stage') AS BIGINT) AS next_start
FROM state_log WHERE kind <> 'delete' AND app NOT IN (SELECT app FROM state_log WHERE kind = 'delete') GROUP BY 1, 2 HAVING count(*) FILTER (WHERE kind = 'stage') > 0"""


@query("j3_replay", J3, ("state_log",))
def _(spark, d):
    return statelog.replay(derived(spark, d, "state_log"))


@query("j4_next_start", "SELECT app, shuffle, max(start + splits) AS next_start FROM state_log WHERE kind = 'stage' GROUP BY 1, 2", ("state_log",))
def _(spark, d):
    return statelog.next_start(derived(spark, d, "state_log"))


@query("j5_config_mismatch", """SELECT app, shuffle, count(DISTINCT num_partitions) AS partitions, count(DISTINCT splits) AS splits FROM state_log WHERE kind = 'stage'
GROUP BY 1, 2 HAVING count(DISTINCT num_partitions) > 1 OR count(DISTINCT splits) > 1""", ("state_log",))
def _(spark, d):
    return statelog.config_mismatches(derived(spark, d, "state_log"))


@query("j7_truncated_files", _after_with(["state_log"], """, b AS (SELECT app, min(seq) AS first FROM state_log WHERE seq % 101 = 50 GROUP BY 1)
SELECT l.app, l.seq, l.kind FROM state_log l LEFT JOIN b USING (app) WHERE first IS NULL OR l.seq < first"""))
def _(spark, d):
    return statelog.before_first_bad(derived(spark, d, "state_log").withColumn("bad", F.col("seq") % 101 == 50), "app", "seq", "bad").select("app", "seq", "kind")


J8 = "SELECT user_id, max(ts) AS last_seen, max(ts) < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 6 HOURS AS expired FROM events GROUP BY 1"


@query("j8_expired_apps", J8)
def _(spark, d):
    return statelog.expired(statelog.liveness([table(spark, d, "events")], "user_id", "ts"), "2024-01-30 20:00:00")


@query("j9_liveness", "SELECT app, max(ts) AS last_seen FROM (SELECT app, ts FROM app_events WHERE event_type = 'view' UNION ALL SELECT app, ts FROM state_log WHERE kind = 'commit') GROUP BY 1", ("app_events", "state_log"))
def _(spark, d):
    return statelog.liveness([derived(spark, d, "app_events").where("event_type = 'view'"), derived(spark, d, "state_log").where("kind = 'commit'")], "app", "ts")


@query("j10_byte_quota", "SELECT app, min(event_id) AS first_over, CAST(arg_min(total, event_id) AS BIGINT) AS total FROM (SELECT app, event_id, sum(n_bytes) OVER (PARTITION BY app ORDER BY event_id) AS total FROM app_events) WHERE total > 20000 GROUP BY 1", ("app_events",))
def _(spark, d):
    return statelog.over_quota(derived(spark, d, "app_events"), "app", "event_id", "n_bytes", 20000)


@query("j11_connections", "SELECT event_id, CAST(open AS BIGINT) AS open, open > 5 AS busy FROM (SELECT event_id, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END) OVER (PARTITION BY app ORDER BY event_id) AS open FROM app_events)", ("app_events",))
def _(spark, d):
    rows = derived(spark, d, "app_events").withColumn("change", F.expr("CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END"))
    return statelog.busy(rows, "app", "event_id", "change", 5).select("event_id", "open", "busy")


@query("j12_idle_channels", "SELECT channel, event_id FROM (SELECT channel, event_id, ts, lag(ts) OVER (PARTITION BY channel ORDER BY ts) AS before FROM app_events) WHERE ts - before >= INTERVAL 7201 SECONDS", ("app_events",))
def _(spark, d):
    return statelog.idle_gaps(derived(spark, d, "app_events"), "channel", "ts", 7200).select("channel", "event_id")


@query("j13_corrupt_stages", "SELECT app, shuffle, bool_or(kind = 'corrupt') AS corrupt FROM state_log GROUP BY 1, 2", ("state_log",))
def _(spark, d):
    return derived(spark, d, "state_log").groupBy("app", "shuffle").agg(F.bool_or(F.col("kind") == "corrupt").alias("corrupt"))


# ------------------------------------------------------------------ L and N: functions, observability


@query("l_integer_ranges", """SELECT l_suppkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM (
  SELECT l_suppkey, min(n) AS a, max(n) AS b FROM (SELECT l_suppkey, n, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS i FROM (SELECT DISTINCT l_suppkey, l_partkey % 60 AS n FROM lineitem)) GROUP BY l_suppkey, i) GROUP BY 1""")
def _(spark, d):
    return fn.integer_ranges(lines(spark, d).select("l_suppkey", (F.col("l_partkey") % 60).alias("n")), ["l_suppkey"], "n")


@query("l_file_paths", "SELECT DISTINCT map_id, p, '/data/' || map_id || '/' || attempt || '/shuffle_' || map_id || '_p_' || p || '.data.' || attempt AS path FROM blocks", ("blocks",))
def _(spark, d):
    c = F.col
    own = derived(spark, d, "blocks").select("map_id", "p", "attempt").distinct()
    return own.select("map_id", "p", fn.file_path("/data", c("map_id"), c("attempt"), fn.file_name(c("map_id"), c("p"), c("attempt"))).alias("path"))


@query("l_host_and_port", "SELECT server_id, split_part(connection, ':', 1) AS host, CAST(split_part(connection, ':', 2) AS INT) AS port FROM servers", ("servers",))
def _(spark, d):
    return derived(spark, d, "servers").select("server_id", fn.host(F.col("connection")).alias("host"), fn.port(F.col("connection")).alias("port"))


@query("l_map_task_info", "SELECT map_id, attempt, base64(unhex(lpad(hex(map_id), 8, '0') || lpad(hex(attempt), 16, '0') || '00000003')) AS info FROM commits", ("commits",))
def _(spark, d):
    return derived(spark, d, "commits").select("map_id", "attempt", fn.map_task_info(F.col("map_id"), F.col("attempt"), F.lit(3)).alias("info"))


@query("l_server_json", "SELECT server_id, connection AS c, version AS v FROM servers", ("servers",))
def _(spark, d):
    text = derived(spark, d, "servers").select("server_id", F.to_json(F.struct(F.col("connection").alias("c"), F.col("version").alias("v"))).alias("j"))
    return text.withColumn("x", F.from_json("j", "c string, v string")).select("server_id", "x.c", "x.v")


@query("n_app_metrics", "SELECT app, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) AS n, min(ts) AS first, max(ts) AS last FROM app_events GROUP BY 1", ("app_events",))
def _(spark, d):
    return derived(spark, d, "app_events").groupBy("app").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


# ------------------------------------------------------------------ M: streams


def _events(spark, d):
    from tidegate.streaming import streams

    return streams.read(spark, d, "events")


@query("m_attempt_states", f"SELECT app, attempt, CASE max(rank) WHEN 2 THEN 'committed' WHEN 1 THEN 'start_upload' ELSE 'not_started' END AS state, count(*) FILTER (WHERE rank = 1) > 1 AS restarted FROM ({MESSAGES}) GROUP BY 1, 2")
def _(spark, d):
    from tidegate.streaming import streams

    messages = _events(spark, d).selectExpr(
        "user_id % 11 AS app", "event_id % 300 AS attempt", "CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 2 ELSE 0 END AS rank"
    )
    return streams.settled(streams.attempt_states(messages), "update", ["app", "attempt"])


@query("m_readable_once", "SELECT event_id % 10 AS p, CAST(4 AS BIGINT) AS n FROM events WHERE event_id % 10 <> 9 GROUP BY 1 HAVING count(DISTINCT user_id % 4) = 4")
def _(spark, d):
    """Partitions 0 to 8 wait for four attempts, 9 also for one that never commits."""
    from tidegate.streaming import streams

    wanted = spark.range(10).selectExpr("id AS p", "explode(CASE WHEN id = 9 THEN array(0, 1, 2, 3, 4) ELSE array(0, 1, 2, 3) END) AS attempt")
    return streams.settled(streams.readable(_events(spark, d).selectExpr("event_id % 10 AS p", "user_id % 4 AS attempt"), wanted), "append")


M_LIVE = """SELECT l.map_id, l.attempt, count(*) AS n FROM (SELECT l_suppkey % 17 AS map_id, CAST(l_linenumber % 3 AS BIGINT) AS attempt FROM lineitem) l
JOIN (SELECT map_id, max(attempt) AS attempt FROM commits GROUP BY 1) w ON l.map_id = w.map_id AND l.attempt = w.attempt GROUP BY 1, 2"""


@query("m_live_blocks", M_LIVE, ("commits",))
def _(spark, d):
    from tidegate.streaming import streams

    blocks = streams.read(spark, d, "lineitem").selectExpr("l_suppkey % 17 AS map_id", "CAST(l_linenumber % 3 AS BIGINT) AS attempt")
    won = commits.winners(derived(spark, d, "commits"))
    return streams.settled(streams.live_blocks(blocks, won, ["map_id", "attempt"]), "append").groupBy("map_id", "attempt").agg(F.count(F.lit(1)).alias("n"))


@query("m_expired_apps", J8)
def _(spark, d):
    from tidegate.streaming import streams

    seen = streams.settled(streams.last_seen(_events(spark, d), "user_id", "ts"), "update", ["key"]).withColumnRenamed("key", "user_id")
    return statelog.expired(seen, "2024-01-30 20:00:00")


@query("m_rates", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    from tidegate.streaming import streams

    rows = _events(spark, d).selectExpr("ts", "CAST(floor(value) AS BIGINT) AS v")
    return streams.settled(streams.rates(rows, "ts", "v", delay=None), "update", ["start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("m_idle_sessions", """WITH g AS (SELECT user_id % 40 AS channel, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 40 ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT channel, ts, sum(fresh) OVER (PARTITION BY channel ORDER BY ts) AS k FROM g)
SELECT channel, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM s GROUP BY channel, k""")
def _(spark, d):
    from tidegate.streaming import streams

    rows = _events(spark, d).selectExpr("ts", "user_id % 40 AS channel")
    out = streams.settled(streams.sessions(rows, "channel", "ts", "2 hours", None), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
