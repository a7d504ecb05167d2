"""Small functions of columns: names of files, addresses, packed numbers, ranges of integers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nine_digits(c: Column) -> Column:
    """With zeros in front, to nine digits or more."""
    return F.format_string("%09d", c)


@F.pandas_udf(T.StringType())
def nine_digits_udf(x: pd.Series) -> pd.Series:
    return x.map("{:09d}".format)


def repeated(text: str, n: Column) -> Column:
    return F.repeat(F.lit(text), n.cast("int"))


def picked(choices: Sequence[str], key: Column) -> Column:
    """One of the choices, by the key's modulus: the repeatable form of a random pick."""
    return F.element_at(F.array(*[F.lit(x) for x in choices]), (F.pmod(key, F.lit(len(choices))) + 1).cast("int"))


def random_pick(choices: Sequence[str]):
    """A pick that differs from run to run; Spark is told so, and won't repeat or move it."""
    import random

    own = list(choices)
    return F.udf(lambda: random.choice(own), T.StringType()).asNondeterministic()


def file_name(shuffle: Column, partition: Column, index: Column) -> Column:
    return F.concat(F.lit("shuffle_"), shuffle.cast("string"), F.lit("_p_"), partition.cast("string"), F.lit(".data."), index.cast("string"))


def file_path(root: str, app: Column, attempt: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit(root), app.cast("string"), attempt.cast("string"), name)


def host(connection: Column) -> Column:
    return F.substring_index(connection, ":", 1)


def port(connection: Column) -> Column:
    """Null where there is none."""
    return F.when(F.instr(connection, ":") > 0, F.substring_index(connection, ":", -1).try_cast("int"))


def map_task_info(map_id: Column, attempt: Column, servers: Column) -> Column:
    """Base64 of the three as big-endian 32, 64 and 32 bits."""
    packed = F.concat(F.lpad(F.hex(map_id), 8, "0"), F.lpad(F.hex(attempt), 16, "0"), F.lpad(F.hex(servers), 8, "0"))
    return F.base64(F.unhex(packed))


def checksum(payload: Column) -> Column:
    return F.crc32(payload)


def integer_ranges(df: DataFrame, keys: Sequence[str], n: str, out: str = "ranges") -> DataFrame:
    """The distinct integers of each key as text: runs as first-last, runs of one alone, with commas between."""
    own = df.select(*keys, n).distinct()
    island = F.col(n) - F.row_number().over(Window.partitionBy(*keys).orderBy(n))
    runs = own.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(n).alias("a"), F.max(n).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ",").alias(out))


def guard_no_speculation(spark) -> None:
    """ValueError where speculation is on: two attempts would then write side by side on purpose."""
    if spark.sparkContext.getConf().get("spark.speculation", "false").lower() == "true":
        raise ValueError("spark.speculation is on")


def backoff(first: int, most: int, total: int) -> list[int]:
    """Waits that double up to ``most``, as long as their sum stays within ``total``."""
    out, wait, spent = [], first, 0
    while spent + wait <= total and wait > 0:
        out.append(wait)
        spent += wait
        wait = min(2 * wait, most)
    return out
