"""Keyed exchange: how rows go to partitions, and what is made of the values of a key.

Every operator is a DataFrame in, a DataFrame out. Spark's own exchange moves the rows: aggregates combine on the map side
first, and adaptive execution sizes and splits what arrives.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_modulus(df: DataFrame, key: str, n: int, out: str = "p") -> DataFrame:
    """The partition of an integer key: its modulus, never negative; 0 if there is one partition; null for a null key."""
    return df.withColumn(out, F.lit(0).cast("long") if n == 1 else F.pmod(F.col(key).cast("long"), F.lit(n)))


def by_hash(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of equal keys in one of n partitions: where ``hash`` of the keys, modulo n, says."""
    return df.repartition(n, *keys)


def placed_by_modulus(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows physically in the partition that ``by_modulus`` names."""
    return df.repartitionById(n, F.pmod(F.col(key), F.lit(n)).cast("int"))


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def sorted_ranges(df: DataFrame, order: Column, n: int) -> DataFrame:
    """n partitions of consecutive ranges, each in order: as a whole, in order."""
    return df.repartitionByRange(n, order).sortWithinPartitions(order)


def rows_by_partition(df: DataFrame, partition: str, n: int) -> DataFrame:
    """p and n_rows of all n partitions, those without rows too."""
    have = df.groupBy(F.col(partition).cast("long").alias("p")).agg(F.count(F.lit(1)).alias("n_rows"))
    return df.sparkSession.range(n).toDF("p").join(have, "p", "left").select("p", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def partition_lengths(df: DataFrame, partition: str, length: str) -> DataFrame:
    """Bytes of each partition, and what a map status reports: 1 where they are 0."""
    sums = df.groupBy(F.col(partition).alias("p")).agg(F.sum(length).alias("bytes"))
    return sums.withColumn("reported", F.greatest("bytes", F.lit(1).cast("long")))


def in_range(df: DataFrame, partition: str, start: int, end: int) -> DataFrame:
    """Partitions start to end - 1, and start in any case."""
    return df.where((F.col(partition) >= start) & (F.col(partition) < max(end, start + 1)))


def conflicting(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys for which ``value`` isn't one and the same."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def reduce_by_key(df: DataFrame, keys: Sequence[str], **out: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in out.items()])


def fold_by_key(df: DataFrame, keys: Sequence[str], value: str, out: str = "s") -> DataFrame:
    """Sums from 0. A zero that changes sums would count once a task, so there is none."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(out))


def group_by_key(df: DataFrame, keys: Sequence[str], value: str, out: str = "vs") -> DataFrame:
    """All values of a key, in order. A key of very many values makes one very large row: prefer an aggregate."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(out))


def combine_to_set(df: DataFrame, keys: Sequence[str], value: str, out: str = "vs") -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(out))


def aggregate_by_key(df: DataFrame, keys: Sequence[str], create: Callable, merge_value: Callable, merge: Callable, schema: str, table_size: int = 100_000, rows_at_once: int = 200_000) -> DataFrame:
    """An aggregate of three functions: of a pandas frame of a key's rows, of a state and more rows, of two states.

    create(frame) -> state (a dict), merge_value(state, frame) -> state, merge(state, state) -> state; states have the
    columns of ``schema`` besides the keys. Each map task keeps a table of states and writes it out whole when it has
    ``table_size`` keys, so only states are shuffled, a few for each key and task however hot the key is. Rows are grouped
    ``rows_at_once`` at a time, so that the functions are called for a key's rows together. That is a call a key and so many
    rows: with many keys, nearly one a row, so prefer ``aggregate_groups`` for these.
    """
    keys = list(keys)
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{key_schema}, {schema}"

    def rows(states: dict) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(keys, k, strict=True)), **s} for k, s in states.items()])

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for f in _joined(frames, rows_at_once):
            for k, own in f.groupby(keys, dropna=False):
                states[k] = merge_value(states[k], own) if k in states else create(own)
            if len(states) >= table_size:
                yield rows(states)
                states = {}
        if states:
            yield rows(states)

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.drop(columns=keys).to_dict("records")
        state = own[0]
        for other in own[1:]:
            state = merge(state, other)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **state}])

    return df.mapInPandas(first, out).groupBy(*keys).applyInPandas(last, out)


def _joined(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for f in frames:
        held.append(f)
        if sum(map(len, held)) >= size:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


#: Pandas types that keep integers beside nulls; other columns stay Arrow's.
NULLABLE = {getattr(pa, t.lower())(): getattr(pd, f"{t}Dtype")() for t in ("Int8", "Int16", "Int32", "Int64", "Float32", "Float64")} | {pa.bool_(): pd.BooleanDtype()}


def aggregate_groups(df: DataFrame, keys: Sequence[str], create: Callable, merge: Callable, schema: str, table_size: int = 1_000_000, rows_at_once: int = 200_000) -> DataFrame:
    """An aggregate of two functions of grouped pandas frames, each called for many keys at once.

    create(groups of rows) and merge(groups of states) return a frame of one state a group, in columns of ``schema``, with
    the groups' keys as its index, as pandas' own aggregates do; a state and more rows are merged once the rows have become
    states. Map tasks hold up to ``table_size`` states, merge them then, and write them out if half are left, so only states
    are shuffled, few a key and task however hot the key is. The states then come sorted and are merged as they come, about
    ``rows_at_once`` at a time. The number of calls follows the rows, not the keys.
    """
    keys = list(keys)
    out = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), schema])
    arrow = df.sparkSession.createDataFrame([], out).toArrow().schema

    def states(f: Callable, frame: pd.DataFrame) -> pd.DataFrame:
        return f(frame.groupby(keys, dropna=False, sort=False)).reset_index()[arrow.names]

    def batch(frame: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(frame, arrow, preserve_index=False)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        for frame in _frames(batches, rows_at_once):
            held.append(states(create, frame))
            if sum(map(len, held)) >= table_size:
                held = [states(merge, pd.concat(held))]
                if len(held[0]) >= table_size / 2:
                    yield batch(held.pop())
        if held:
            yield batch(states(merge, pd.concat(held)))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for frame in _frames(batches, rows_at_once):
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            group = frame.groupby(keys, dropna=False, sort=False).ngroup()
            open_ = group == group.iloc[-1]  # the key that may go on in the next frame
            if not open_.all():
                yield batch(states(merge, frame[~open_]))
            held = states(merge, frame[open_])
        if held is not None:
            yield batch(held)

    return df.mapInArrow(first, out).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(last, out)


def _frames(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pd.DataFrame]:
    held: list[pa.RecordBatch] = []
    for b in itertools.chain(batches, [None]):
        held += [b] if b is not None and b.num_rows else []
        if held and (b is None or sum(x.num_rows for x in held) >= size):
            yield pa.Table.from_batches(held).to_pandas(types_mapper=lambda t: NULLABLE.get(t) or pd.ArrowDtype(t))
            held = []


def two_level(df: DataFrame, keys: Sequence[str], part: str, value: str) -> DataFrame:
    """Combined within each ``part`` (a map task, or a salt for a hot key), then over all: s and n."""
    inner = df.groupBy(*keys, part).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    return inner.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _bucket(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width).alias("_bucket")


def _with(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows with the right's other columns; null keys meet."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, "left").drop(*[f"_r_{k}" for k in keys])


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str | Column, width: int, out: str = "running") -> DataFrame:
    """The sum of ``value`` over a key's rows up to each, in order of an integer that differs within the key.

    Rows are summed in buckets of ``width`` of the order, so that no task sorts more of a key than one bucket; the buckets'
    sums, one row each, say where each begins.
    """
    keys, own = list(keys), df.select("*", _bucket(order, width), (value if isinstance(value, Column) else F.col(value)).alias("_value"))
    sums = own.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = _with(own.withColumn("_inner", F.sum("_value").over(inner)), base, [*keys, "_bucket"])
    return both.withColumn(out, F.col("_base") + F.col("_inner")).drop("_bucket", "_value", "_inner", "_base")


def flushes(df: DataFrame, task: str, order: str, width: int, every: int, size: str | None = None, out: str = "epoch") -> DataFrame:
    """The number of the flush that writes each record, if a map task writes its table out after ``every`` records, or bytes."""
    total = running_sum(df, [task], order, size if size else F.lit(1), width, "_total")
    return total.withColumn(out, F.floor((F.greatest(F.col("_total"), F.lit(1)) - 1) / every).cast("long")).drop("_total")


def best_effort_combine(df: DataFrame, task: str, epoch: str, keys: Sequence[str], value: str) -> DataFrame:
    """What map tasks write if each combines in a table by (partition, key) that it writes out whole at each flush.

    One row a task, flush and key: ``combined`` values of ``records`` records.
    """
    return df.groupBy(task, epoch, *keys).agg(F.sum(value).alias("combined"), F.count(F.lit(1)).alias("records"))


def reduction_factor(read: Column, written: Column) -> Column:
    return F.when(read == 0, F.lit(0.0)).otherwise(F.round(1 - written / read, 6))


def latest(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The largest ``by`` of each key."""
    return df.groupBy(*keys).agg(F.max(by).alias(by))


def moving_average(df: DataFrame, keys: Sequence[str], order: str, value: str, size: int, width: int, out: str = "average", scale: int = 0, block: int = 1_000_000) -> DataFrame:
    """Of each row the average of it and the ``size - 1`` rows before, half rounded up to ``scale`` decimals (0: a long).

    Rows are numbered (in buckets of ``width``, as in ``running_sum``) and averaged in blocks of ``block`` rows; the last rows
    of a block are also sent to the next, so no task sorts more of a key than that.
    """
    keys, block = list(keys), max(block, size)
    own = running_sum(df, keys, order, F.lit(1), width, "_at").withColumn("_block", F.floor((F.col("_at") - 1) / block)).withColumn("_sent", F.lit(False))
    tail = own.where((F.col("_at") - 1) % block >= block - (size - 1)).withColumn("_block", F.col("_block") + 1).withColumn("_sent", F.lit(True))
    w = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(-(size - 1), 0)
    average = F.floor(F.avg(value).over(w) * 10**scale + 0.5)
    rows = own.unionByName(tail).withColumn(out, average if scale == 0 else average / 10**scale)
    return rows.where("NOT _sent").drop("_at", "_block", "_sent")


def one_value(df: DataFrame, keys: Sequence[str], value: str, out: str = "consistent") -> DataFrame:
    """Whether a key has one value alone."""
    return df.groupBy(*keys).agg((F.count_distinct(value) == 1).alias(out))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of two rows or more, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n a task before it moves any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def is_sorted(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Pairs of neighbours that are out of order, by key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("before", F.lag(value).over(w)).groupBy(*keys).agg(F.count_if(F.col("before") > F.col(value)).alias("inversions"))
