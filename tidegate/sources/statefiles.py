"""The state log as files of typed items, a JSON object a line, in one file folder an hour.

Items are appended; a reader takes each file in order and stops it at its first line that is no item, and goes on with the
next file. Files are small by rotation, and each is read as one row, so that its lines keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every item has seq, ts, app and a kind; the others are those of its kind (stage: shuffle, num_partitions, start, splits;
#: commit: shuffle, attempts, files; corrupt: shuffle; delete: none) and null otherwise.
ITEM = "seq long, ts timestamp_ntz, kind string, app long, shuffle long, num_partitions long, start long, splits long, attempts array<long>, files array<struct<p:long,path:string,length:long>>"
NEEDED = {"stage": ["shuffle", "num_partitions", "start", "splits"], "commit": ["shuffle", "attempts"], "corrupt": ["shuffle"], "delete": []}


def is_item(item: Column) -> Column:
    """Whether a parsed line has a known kind and all that the kind needs."""
    known = F.lit(False)
    for kind, names in NEEDED.items():
        full = item["kind"] == kind
        for name in names:
            full = full & item[name].isNotNull()
        known = known | full
    return F.coalesce(item["seq"].isNotNull() & item["ts"].isNotNull() & item["app"].isNotNull() & known, F.lit(False))


def append(items: DataFrame, folder: str) -> None:
    """Adds items (any of ITEM's columns) to the files of their hours, in order of seq within each file."""
    line = F.to_json(F.struct(*[F.col(c) for c in items.columns]))
    rows = items.withColumn("file", F.concat(F.lit("v1_"), F.date_format("ts", "yyyyMMddHH")))
    rows = rows.repartition("file").sortWithinPartitions("file", "seq")
    rows.select(line.alias("value"), "file").write.mode("append").partitionBy("file").text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """file (of the hour), part (the file's own name), line (from 0) and the items before each file's first bad line."""
    texts = spark.read.text(folder, wholetext=True).select("file", F.col("_metadata.file_name").alias("part"), "value")
    lines = F.filter(F.split("value", "\n"), lambda x: x != "")
    parsed = texts.withColumn("items", F.transform(lines, lambda x: F.from_json(x, ITEM)))
    places = F.transform("items", lambda x, i: F.when(~is_item(x), i))
    end = F.coalesce(F.array_min(places), F.size("items"))
    good = parsed.select("file", "part", F.posexplode(F.slice("items", F.lit(1), end)).alias("line", "item"))
    return good.select("file", "part", "line", "item.*")
