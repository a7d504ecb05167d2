"""Operators on inputs of their own: counts that are known, nulls, empties and errors."""

import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate.functions import scalars as fn
from tidegate.operators import buffers, commits, keyed, observed, placement, replicas, statelog
from tidegate.plans import catalog
from tidegate.sources import blockfiles, generated, statefiles, tables
from tidegate.streaming import streams

SF = "/root/testdata/sf0.001"


def test_reduce_by_key_of_pairs(spark):
    pairs = spark.range(0, 1000, 1, 3).selectExpr("id div 2 AS k", "id * 2 AS v")
    got = keyed.reduce_by_key(pairs, ["k"], s=F.sum("v"))
    assert got.count() == 500
    assert got.where("s <> 4 * k + (2 * k + 1) * 2").isEmpty()


def test_best_effort_combine_counts(spark):
    """500 keys of two neighbouring records: all pairs combine with a large table, none without one, some between."""
    rows = spark.range(0, 1000).selectExpr("id div 100 AS task", "id div 2 % 5 AS p", "id div 2 AS k", "id AS seq", "id * 2 AS v", "24 AS size")

    def written(df, every, size=None):
        return keyed.best_effort_combine(keyed.flushes(df, "task", "seq", 64, every, size), "task", "epoch", ["p", "k"], "v").count()

    assert [written(rows, n) for n in (1000, 1)] == [500, 1000] and 500 < written(rows, 3) < 1000
    assert [written(rows, n, "size") for n in (5 << 20, 24)] == [500, 1000] and 500 < written(rows, 72, "size") < 1000
    one_key = rows.withColumn("k", F.lit(0)).withColumn("p", F.lit(0))
    assert (written(one_key, 1000), written(one_key, 1)) == (10, 1000)
    assert (written(rows.where("seq = 0"), 1000), written(rows.limit(0), 1000)) == (1, 0)


def test_running_sums_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 1, None]), k * 3 + rng.randint(0, 2), rng.randint(-5, 9)) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(5)
    want, averages, sums = {}, {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        sums.setdefault(k, []).append(v)
        want[o] = sum(sums[k])
        averages[o] = math.floor(sum(sums[k][-7:]) / len(sums[k][-7:]) + 0.5)
    for width in (7, 100, 10**6):
        assert {r.o: r.running for r in keyed.running_sum(df, ["k"], "o", "v", width).collect()} == want
        for block in (1, 50, 10**6):
            assert {r.o: r.average for r in keyed.moving_average(df, ["k"], "o", "v", 7, width, block=block).collect()} == averages
    assert keyed.running_sum(df.limit(0), ["k"], "o", "v", 7).count() == 0


def test_moving_average_is_whole_and_rounds_up(spark):
    """Averages are whole numbers, halves rounded up; before the window is full, over what is there."""
    df = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 6), (0, 4, -3)], "k long, o long, v long")
    assert [r.average for r in keyed.moving_average(df, ["k"], "o", "v", 2, 10).orderBy("o").collect()] == [1, 2, 4, 2]
    assert [r.average for r in keyed.moving_average(df, ["k"], "o", "v", 2, 10, scale=1).orderBy("o").collect()] == [1.0, 1.5, 4.0, 1.5]


def test_idle_gaps_over_empty_days(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-05 00:00:00", "2024-01-05 23:59:59", "2024-01-06 00:00:10"]
    df = spark.createDataFrame([(c, t) for c in (1, 2) for t in times], "c long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = sorted((r.c, str(r.t), r.gap_s) for r in statelog.idle_gaps(df, "c", "t", 7200).collect())
    assert got == [(c, t, g) for c in (1, 2) for t, g in ((times[2], 342000), (times[3], 86399))]


def test_orders_are_kept(spark):
    from tidegate.plans import catalog

    rows = catalog.QUERIES["e1_total_order"](spark, SF).collect()
    assert rows == sorted(rows, key=lambda r: (r.s, r.k))
    parts = catalog.QUERIES["e2_sorted_within"](spark, SF).withColumn("part", F.spark_partition_id()).collect()
    for p in {r.part for r in parts}:
        own = [(r.l_suppkey, r.l_orderkey) for r in parts if r.part == p]
        assert own == sorted(own)
    assert len(parts) == tables.table(spark, SF, "lineitem").count()
    groups = [r.group_id for r in catalog.QUERIES["i6_groups_in_turn"](spark, SF).collect()]
    assert groups == sorted(groups) and set(groups) == {0, 1, 2}
    flushed = catalog.QUERIES["g5_sorted_flush"](spark, SF).withColumn("part", F.spark_partition_id()).collect()
    for p in {r.part for r in flushed}:
        own = [r.p for r in flushed if r.part == p]
        assert own == sorted(own)
    ranges = [r.o_custkey for r in catalog.QUERIES["c3_range_sorted"](spark, SF).collect()]
    assert ranges == sorted(ranges, reverse=True)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_every_outcome_occurs(spark, sf):
    """The derived tables reach every branch of the queries that tell states apart."""
    from tidegate.plans import catalog

    folder = f"/root/testdata/sf{sf}"
    values = lambda name, column: {r[0] for r in catalog.QUERIES[name](spark, folder).select(column).distinct().collect()}
    for name in ("flagship_readable_partitions", "h6_availability"):
        assert values(name, "status") == {"ok", "not_available", "not_started"}
    assert values("e10_containment", "p") == {3, 4, 5, 6}  # any attempt of map task 5 will do
    assert values("i1_replicated_writes", "status") == {"ok", "failed", "no_replica"} and values("i1_replicated_writes", "used") == {0, 1, 2, 3}
    assert values("j3_replay", "status") == {"ok", "corrupted"}
    assert values("h8_stage_status", "status") == {"ok", "corrupted", "not_started"}
    assert values("j8_expired_apps", "expired") == {True, False}
    assert 0 < catalog.QUERIES["j5_config_mismatch"](spark, folder).count() < 40


def test_null_keys_and_values_survive(spark):
    rows = spark.createDataFrame([(None, ""), ("", None), (None, None)], "k string, v string")
    assert sorted(keyed.by_hash(rows, ["k"], 4).collect(), key=str) == sorted(rows.collect(), key=str)
    assert keyed.combine_to_set(rows, ["k"], "v").count() == 2


def test_sorted_ranges_descend(spark):
    rows = spark.range(0, 1000, 1, 3).selectExpr("id AS k", "id * 2 AS v")
    got = [r.k for r in keyed.sorted_ranges(rows, F.col("k").desc(), 5).collect()]
    assert got == list(range(999, -1, -1))


def test_empty_partition(spark):
    rows = keyed.by_modulus(spark.createDataFrame([(k, k) for k in (0, 2, 4, 6, 8)], "k long, v long"), "k", 2)
    assert {r.p: r.n_rows for r in keyed.rows_by_partition(rows, "p", 2).collect()} == {0: 5, 1: 0}


def test_partition_range_reads_its_start(spark):
    rows = spark.range(100).selectExpr("id % 5 AS p")
    assert keyed.in_range(rows, "p", 0, 0).count() == 20
    assert keyed.in_range(rows, "p", 0, 2).count() == 40


def test_retried_tasks_are_read_once(spark):
    blocks = spark.range(0, 20000).selectExpr("id % 10 AS map_id", "id % 10 + 1000 * (1 + id div 10000) AS attempt", "id % 2 AS p")
    done = blocks.select("map_id", "attempt").distinct()
    assert commits.live(blocks, commits.winners(done), ["map_id", "attempt"]).count() == 10000


def test_availability(spark):
    fetch = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (2, 3)], "p long, map_id long")
    done = spark.createDataFrame([(1,)], "map_id long")
    got = {r.p: r.status for r in commits.availability(fetch, done, ["p"], ["map_id"]).collect()}
    assert got == {0: "not_available", 1: "ok", 2: "not_started"}


def test_groups_drop_the_tail_and_route_inside(spark):
    servers = spark.createDataFrame([(i,) for i in range(5)], "server_id long")
    assert [r.members for r in placement.replica_groups(servers, "server_id", 3).collect()] == [[0, 1, 2]]
    with pytest.raises(ValueError):
        placement.replica_groups(servers, "server_id", 0)
    with pytest.raises(ValueError):
        placement.groups_of_partitions(spark.range(3).toDF("p"), 2, 3)
    own = placement.groups_of_partitions(spark.range(50).toDF("p"), 7, 3)
    tasks = spark.range(50).toDF("p").crossJoin(spark.range(10).toDF("attempt"))
    routed = tasks.withColumn("group_id", placement.routed_group(F.col("p"), F.col("attempt"), 7, 3))
    assert routed.join(own, ["p", "group_id"], "left_anti").isEmpty()


def test_buffers_by_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        records = [(rng.randint(0, 4), rng.randint(0, 9)) for _ in range(rng.randint(0, 200))]
        packer, blocks, open_bytes = buffers.Packer(10, 20), [], {}
        for p, size in records:
            left = packer.add(p, size)
            open_bytes[p] = open_bytes.get(p, 0) + size
            if open_bytes[p] >= 10:
                want = [(p, open_bytes.pop(p))]
            elif sum(open_bytes.values()) >= 20:
                want, open_bytes = sorted(open_bytes.items()), {}
            else:
                want = []
            assert [(b[0], b[3]) for b in left] == want
            blocks += left
        blocks += packer.flush()
        assert packer.total == 0 and not packer.open
        assert [b[1] for b in blocks] == list(range(len(blocks)))
        assert sum(b[2] for b in blocks) == len(records) and sum(b[3] for b in blocks) == sum(x for _, x in records)


def test_packed_blocks_keep_all_records(spark):
    rows = spark.range(2000).selectExpr("id % 3 AS task", "id % 5 AS p", "id AS seq", "id % 11 AS length")
    got = buffers.pack_blocks(rows, "task", "p", "seq", "length", 10, 20)
    assert got.agg(F.sum("n_records"), F.sum("bytes")).first() == rows.agg(F.count("*"), F.sum("length")).first()


def test_block_files(spark, tmp_path):
    good = blockfiles.encode([(1, b"abc"), (2, b""), (1, b"x" * 100)])
    (tmp_path / "shuffle_0_p_0.data.0").write_bytes(good)
    (tmp_path / "shuffle_0_p_1.data.0").write_bytes(good[:-1])
    (tmp_path / "shuffle_0_p_2.data.0").write_bytes(b"")
    rows = blockfiles.read(spark, str(tmp_path)).collect()
    assert [(r.attempt, bytes(r.payload)) for r in sorted((r for r in rows if r.error is None), key=lambda r: r.seq)] == [(1, b"abc"), (2, b""), (1, b"x" * 100)]
    assert [r.file for r in rows if r.error] == ["shuffle_0_p_1.data.0"]


def test_store_appends(spark, tmp_path):
    rows = generated.key_values(spark, 10, 2)
    tables.store(rows, str(tmp_path / "t"))
    assert tables.store(rows, str(tmp_path / "t"), "append").count() == 20


def test_replicas(spark):
    """Each step goes to all replicas alive; one that fails is dropped for good; with none left a step is in error."""
    fails = {(0, 1), (1, 3), (0, 4)}
    steps = spark.createDataFrame([(0, r, s, (r, s) not in fails) for r in range(2) for s in range(6)], "grp long, replica long, step long, ok boolean")
    got = {r.step: (r.used, r.took, r.status) for r in replicas.write_outcomes(steps, "grp", "replica", "step", "ok").collect()}
    assert got == {0: (2, 2, "ok"), 1: (2, 1, "ok"), 2: (1, 1, "ok"), 3: (1, 0, "failed"), 4: (0, 0, "no_replica"), 5: (0, 0, "no_replica")}


def test_content_differences_count_repeats(spark):
    a = spark.createDataFrame([(1, 5), (1, 5), (2, 7), (None, 1)], "k long, v long")
    b = spark.createDataFrame([(1, 5), (2, 8), (None, 1)], "k long, v long")
    assert sorted(tuple(r) for r in replicas.content_differences(a, b, ["k"], "v").collect()) == [(1, 5, "first"), (2, 7, "first"), (2, 8, "second")]


LOG = "seq long, kind string, app long, shuffle long, num_partitions long, start long, splits long"


def replayed(spark, items):
    rows = [(k, kind, app, shuffle, *(more or (8, 0, 1))) for k, (kind, app, shuffle, *more) in enumerate(items)]
    return {(r.app, r.shuffle): (r.status, r.commits, r.next_start) for r in statelog.replay(spark.createDataFrame(rows, LOG)).collect()}


def test_replay_of_items_in_order(spark):
    stage, commit, corrupt, delete = ("stage", 1, 0), ("commit", 1, 0), ("corrupt", 1, 0), ("delete", 1, None)
    assert replayed(spark, [stage, commit, commit]) == {(1, 0): ("ok", 2, 1)}
    assert replayed(spark, [commit, stage]) == {(1, 0): ("corrupted", 1, 1)}
    assert replayed(spark, [commit]) == {} and replayed(spark, [corrupt]) == {}
    assert replayed(spark, [corrupt, stage, commit]) == replayed(spark, [stage, commit, corrupt]) == {(1, 0): ("corrupted", 1, 1)}
    assert replayed(spark, [stage, commit, delete]) == replayed(spark, [delete, stage]) == {}
    assert replayed(spark, [stage, ("stage", 1, 0, 9, 0, 1)]) == {(1, 0): ("corrupted", 0, 1)}
    assert replayed(spark, [stage, ("stage", 1, 0, 8, 0, 3)]) == {(1, 0): ("corrupted", 0, 3)}
    # a restart announces the stage again, with files that start after the old ones
    assert replayed(spark, [("stage", 1, 0, 8, 0, 3), commit, ("stage", 1, 0, 8, 3, 3), commit]) == {(1, 0): ("ok", 2, 6)}
    assert replayed(spark, [stage, ("stage", 2, 0), ("commit", 2, 0), ("stage", 1, 7), ("corrupt", 1, 7)]) == {(1, 0): ("ok", 0, 1), (2, 0): ("ok", 1, 1), (1, 7): ("corrupted", 0, 1)}


def test_state_files_stop_at_the_first_bad_item(spark, tmp_path):
    items = [(k, f"2024-01-01 0{k // 4}:00:0{k % 4}", ["stage", "commit", "corrupt", "delete"][k % 4], 1, k % 3 if k % 4 < 3 else None) for k in range(12)]
    df = spark.createDataFrame(items, "seq long, ts string, kind string, app long, shuffle long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df = df.withColumns({c: F.when(F.col("kind") == "stage", F.lit(n)) for c, n in (("num_partitions", 8), ("start", 0), ("splits", 2))})
    df = df.withColumn("attempts", F.when(F.col("kind") == "commit", F.array(F.lit(5), F.lit(6))))
    folder = f"file://{tmp_path}/log"
    statefiles.append(df.where("seq < 8"), folder)
    statefiles.append(df.where("seq >= 8"), folder)
    got = statefiles.read(spark, folder).orderBy("seq").collect()
    assert [(r.seq, r.kind, r.line) for r in got] == [(k, x[2], k % 4) for k, x in enumerate(items)]
    assert [r.attempts for r in got if r.kind == "commit"] == [[5, 6]] * 3 and {r.file for r in got} == {"v1_2024010100", "v1_2024010101", "v1_2024010102"}
    # a line cut off, an unknown kind, a commit without attempts: each ends its file, and later files go on
    for hour, line, bad in (("00", 2, '{"seq": 2, "ki'), ("01", 1, '{"seq":5,"ts":"2024-01-01T01:00:01","kind":"other","app":1}'), ("02", 3, '{"seq":11,"ts":"2024-01-01T02:00:03","kind":"commit","app":1,"shuffle":1}')):
        (path,) = (tmp_path / "log" / f"file=v1_20240101{hour}").glob("*.txt")
        own = path.read_text().splitlines()
        own[line] = bad
        path.write_text("\n".join(own) + "\n")
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    assert sorted(r.seq for r in statefiles.read(spark, folder).collect()) == [0, 1, 4, 8, 9, 10]


def test_snapshot_is_saved_once(spark, tmp_path):
    blocks = spark.createDataFrame([(0, 1, 0, 5), (0, 2, 0, 9), (1, 1, 0, 7)], "map_id long, attempt long, p long, len long")
    first, later = (commits.snapshot(blocks, spark.createDataFrame(x, "map_id long, attempt long"), ["p"], ["map_id", "attempt"], "len") for x in ([(0, 1)], [(0, 1), (1, 1)]))
    path = f"file://{tmp_path}/saved"
    assert [r.length for r in commits.save_once(first, path).collect()] == [5]
    assert [r.length for r in commits.save_once(later, path).collect()] == [5]
    assert [r.length for r in commits.start_again(later, path).collect()] == [12]


def test_disk_cache_and_totals(spark):
    rows = tables.on_disk(spark.range(100).toDF("v"))
    assert rows.storageLevel.useDisk and not rows.storageLevel.useMemory
    counted, seen = observed.observed(rows, "in", n=F.count("*"), total=F.sum("v"))
    moved = counted.repartition(4, "v").agg(F.count("*").alias("n"), F.sum("v").alias("total")).first()
    assert seen.get == moved.asDict() == {"n": 100, "total": 4950}
    rows.unpersist()


def test_stream_counts(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    counts = observed.StreamCounts()
    spark.streams.addListener(counts)
    try:
        streams.settled(streams.read(spark, str(tmp_path), "t"), "append")
        broken = streams.read(spark, str(tmp_path), "t").selectExpr("CAST(raise_error('bad') AS long) AS x")
        with pytest.raises(Exception, match="bad"):
            streams.settled(broken, "append")
        for _ in range(100):
            if counts.ended == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counts)
    assert (counts.started, counts.ended, counts.failed, counts.rows) == (2, 2, 1, 30)


def test_candidates_are_asked_in_order(spark):
    servers = spark.createDataFrame([(k, None if k < 3 else 100, 20 - k) for k in range(20)], "server_id long, latency long, conns long")
    got = placement.ranked(placement.candidates(servers, 4), 4).orderBy("place").collect()
    assert [r.server_id for r in got] == [7, 6, 5, 4]  # of 0 to 7, the first three aren't reached
    assert placement.candidates(servers, 8).count() == 13


def test_custom_aggregate_of_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 0 ELSE id % 7 END AS k", "id AS v")
    total = keyed.aggregate_by_key(rows, ["k"], lambda f: {"s": int(f.v.sum())}, lambda s, f: {"s": s["s"] + int(f.v.sum())}, lambda a, b: {"s": a["s"] + b["s"]}, "s long")
    assert {r.k: r.s for r in total.collect()} == {r.k: r.s for r in rows.groupBy("k").agg(F.sum("v").alias("s")).collect()}


def test_aggregate_groups(spark):
    big = (1 << 60) + 1
    data = [(k % 7 if k % 5 else None, ("a", "b", None)[k % 3], None if k % 7 == 3 or k % 11 == 0 else k) for k in range(1500)] + [(big, "a", big), (big + 1, "a", 1)]
    rows = spark.createDataFrame(data, "k long, t string, v long").repartition(6)

    def create(g):
        return pd.DataFrame({"s": g.v.sum(min_count=1), "n": g.v.size()})

    def merge(g):
        return pd.DataFrame({"s": g.s.sum(min_count=1), "n": g.n.sum()})

    for keys in (["k"], ["t", "k"]):
        want = sorted(map(str, rows.groupBy(*keys).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()))
        for size in ({}, {"table_size": 3, "rows_at_once": 4}):
            got = keyed.aggregate_groups(rows, keys, create, merge, "s long, n long", **size)
            assert sorted(map(str, got.collect())) == want
    assert not keyed.aggregate_groups(rows.where("false"), ["k"], create, merge, "s long, n long").collect()


def test_d6_calls_follow_the_rows_not_the_keys(spark, tmp_path):
    lines = spark.range(0, 40_000, 1, 2).selectExpr("id % 20000 AS l_suppkey", "IF(id % 20000 = 5, NULL, CAST(id % 7 AS INT)) AS l_linenumber")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.QUERIES["d6_custom_aggregate"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    want = spark.read.parquet(str(tmp_path / "lineitem.parquet")).groupBy("l_suppkey").agg(F.sum("l_linenumber"), F.max("l_linenumber").cast("long"), F.count(F.lit(1)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scalars(spark):
    assert fn.backoff(100, 400, 1200) == [100, 200, 400, 400]
    fn.guard_no_speculation(spark)
    on = type("Session", (), {"sparkContext": type("Context", (), {"getConf": lambda self: {"spark.speculation": "true"}})()})()
    with pytest.raises(ValueError):
        fn.guard_no_speculation(on)
    row = spark.range(1).select(fn.port(F.lit("a")).alias("a"), fn.port(F.lit("a:7")).alias("b"), fn.nine_digits(F.lit(12345678901)).alias("c")).first()
    assert tuple(row) == (None, 7, "12345678901")
    assert {r[0] for r in spark.range(20).select(fn.random_pick(["x", "y"])()).collect()} <= {"x", "y"}


def test_expiring_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")], "k long, ts string").coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    spark.createDataFrame([(2, "2024-01-01 05:00:00")], "k long, ts string").coalesce(1).write.mode("append").parquet(str(tmp_path / "e.parquet"))
    spark.createDataFrame([(3, "2024-01-01 10:00:00")], "k long, ts string").coalesce(1).write.mode("append").parquet(str(tmp_path / "e.parquet"))
    events = streams.read(spark, str(tmp_path), "e").withColumn("ts", F.col("ts").cast("timestamp"))
    got = streams.settled(streams.expiring(events, "k", "ts", "0 seconds", 6), "append").collect()
    assert [(r.key, str(r.last_seen)) for r in got] == [(1, "2024-01-01 00:00:00")]


def cut(spark, folder, name, pieces):
    """A table in several files, the last rows first."""
    rows = tables.table(spark, SF, name).toPandas()
    size = -(-len(rows) // pieces)
    (folder / f"{name}.parquet").mkdir()
    for k in range(pieces):
        part = rows.iloc[(pieces - 1 - k) * size : (pieces - k) * size]
        spark.createDataFrame(part, tables.table(spark, SF, name).schema).coalesce(1).write.mode("append").parquet(str(folder / f"{name}.parquet"))


def test_streams_of_files_out_of_order(spark, tmp_path):
    """All streams over tables in four files, latest first, give what SQL gives over the whole."""
    from tests.compare import connect, differences
    from tidegate.plans import catalog

    cut(spark, tmp_path, "events", 4)
    cut(spark, tmp_path, "lineitem", 4)
    tables.table(spark, SF, "orders").write.parquet(str(tmp_path / "orders.parquet"))
    con = connect(SF)
    for name in sorted(n for n in catalog.QUERIES if n.startswith("m_")):
        assert not differences(spark, catalog.QUERIES[name], catalog.SQL[name], str(tmp_path), con), name


def test_stream_passes_over_stale_attempts(spark, tmp_path):
    """Blocks of an old attempt that come before or after those of the new one are passed over, by id and not by time."""
    for attempt, value in ((3, 100), (4, 300), (3, 500), (4, 400)):
        spark.createDataFrame([(2, attempt, value)], "map_id long, attempt long, value long").coalesce(1).write.mode("append").parquet(str(tmp_path / "b.parquet"))
    won = spark.createDataFrame([(2, 4)], "map_id long, attempt long")
    got = streams.settled(streams.live_blocks(streams.read(spark, str(tmp_path), "b"), won, ["map_id", "attempt"]), "append")
    assert sorted(r.value for r in got.collect()) == [300, 400]


def test_stream_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "e.parquet"))
    assert streams.settled(streams.last_seen(streams.read(spark, str(tmp_path), "e"), "user_id", "ts"), "update", ["key"]).count() == 0


def test_rates_of_files_out_of_time_order(spark, tmp_path):
    from tidegate.plans import catalog

    for day in (9, 3, 7, 1):
        rows = spark.range(0, 50, 1, 1).selectExpr(f"CAST(TIMESTAMP '2024-01-0{day} 00:00:00' + make_interval(0, 0, 0, 0, 0, 7 * id, 0) AS TIMESTAMP_NTZ) AS ts", "CAST(id AS DOUBLE) AS value")
        rows.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["m_rates"](spark, str(tmp_path)).collect()
    want = spark.read.parquet(str(tmp_path / "events.parquet")).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz")).agg(F.sum("value"), F.count("*")).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)
    assert sum(r.n for r in got) == 200


def test_shapes_of_all_parts(spark, tmp_path):
    from tidegate.plans import catalog

    spark.createDataFrame([(1, 3), (499, 7), (500, 11), (9000, 50)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("f1_server_count", "f2_fanout"):
        assert sorted(r.maps for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == [3, 7, 11, 50]


def test_quota_of_an_empty_log(spark):
    empty = generated.empty(spark, "app long, event_id long, n_bytes long")
    assert statelog.over_quota(empty, "app", "event_id", "n_bytes", 1).count() == 0
