"""Inputs that are made up: ranges, and pairs of repeated letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbers(spark: SparkSession, start: int, end: int, tasks: int, step: int = 1) -> DataFrame:
    return spark.range(start, end, step, tasks)


def key_values(spark: SparkSession, rows: int, tasks: int, max_length: int = 20) -> DataFrame:
    """id, key, value: one letter each, again and again; the same for the same id."""
    ids = spark.range(0, rows, 1, tasks)
    letter = lambda c: F.char(F.lit(97) + F.pmod(c, F.lit(26)))
    n = lambda c: (F.lit(1) + F.pmod(c, F.lit(max_length))).cast("int")
    return ids.select("id", F.repeat(letter(F.col("id") * 7), n(F.col("id") * 3)).alias("key"), F.repeat(letter(F.col("id") * 11), n(F.col("id") * 5)).alias("value"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """What a shuffle of no map tasks gives."""
    return spark.createDataFrame([], schema)
