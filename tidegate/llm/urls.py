"""URL filter: a trie over reversed host labels and path segments, with the longest rule that fits deciding.

A rule is a verdict, a host and a path. It fits the host itself and every subdomain, where the URL's path starts with the
rule's. Of the rules that fit, that of most characters wins; of equally long ones, the longer host; of equal rules, block.
Null URLs and those without ``://`` have an empty host and path, which only an empty host's rules fit. URLs that no rule
fits get ``otherwise``. Rows come out as they went in, repeated ones too; an empty table gives none. Columns are added, and
a ValueError says where one of that name is there already. Null hosts and paths of rules count as empty.

The trie goes to every task, and is built once a Python worker, while its rules are at most ``max_rules`` and MAX_CHARS
characters. Beyond, rules are joined on equal host suffixes and path prefixes, so that each URL meets only rules that fit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, schema_of, table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
#: Bounds of what is broadcast: a trie of so many rules takes some 100 MB in a Python worker.
MAX_RULES, MAX_CHARS = 100_000, 8_000_000


class _Node:
    __slots__ = ("below", "paths")

    def __init__(self):
        self.below: dict[str, _Node] = {}
        self.paths: _Segment | None = None


class _Segment:
    """Rules whose path has come so far: by what the rest of the path has to start with, which has no slash."""

    __slots__ = ("below", "ends")

    def __init__(self):
        self.below: dict[str, _Segment] = {}
        self.ends: dict[str, Rule] = {}


class Trie:
    def __init__(self, rules: list[Rule]):
        self.top = _Node()
        for rule in rules:
            node = self.top
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.below.setdefault(label, _Node())
            node.paths = node.paths or _Segment()
            *whole, rest = rule.path.split("/")
            at = node.paths
            for segment in whole:
                at = at.below.setdefault(segment, _Segment())
            old = at.ends.get(rest)
            if old is None or rule.verdict == "block":
                at.ends[rest] = rule

    def find(self, host: str, path: str) -> Rule | None:
        node, hosts = self.top, [self.top]
        for label in reversed(host.split(".")) if host else ():
            if (node := node.below.get(label)) is None:
                break
            hosts.append(node)
        segments, best = path.split("/"), None
        for node in hosts:  # longer hosts later, so that they win among equally long rules
            at, k = node.paths, 0
            while at is not None:
                segment = segments[k]
                for rest, rule in at.ends.items() if len(at.ends) < 9 else ((segment[:n], at.ends.get(segment[:n])) for n in range(len(segment) + 1)):
                    if rule is not None and segment.startswith(rest) and (best is None or len(rule.text) >= len(best.text)):
                        best = rule
                at = at.below.get(segment) if k + 1 < len(segments) else None
                k += 1
        return best


def _no_clash(df: DataFrame, names: tuple[str, ...]) -> None:
    if clash := set(names) & {c.lower() for c in df.columns}:
        raise ValueError(f"{sorted(clash)} clash with columns of the pages")


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows with ``host`` and ``path`` of their URLs. ValueError if there is such a column."""
    _no_clash(pages, ("host", "path"))
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"(?s)^([^?#]*)", 1)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": lower, "path": F.substr(rest, F.char_length(host) + 1)})


def judge(parts: DataFrame, rules: list[Rule] | DataFrame, otherwise: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """Rows that have ``host`` and ``path``, with ``rule`` (null: none) and ``verdict``. ValueError if there is such a column.

    rules: a list, or a DataFrame of verdict, host and path.
    """
    _no_clash(parts, ("rule", "verdict"))
    spark = parts.sparkSession
    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        n, chars = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("host") + F.char_length("path")), F.lit(0))).first()
        if n > max_rules or chars > MAX_CHARS:
            return _judge_joined(parts, rules, otherwise)
        rules = [Rule(*r) for r in rules.collect()]
    elif len(rules) > max_rules or sum(len(r.text) for r in rules) > MAX_CHARS:
        return _judge_joined(parts, spark.createDataFrame(rules, "verdict string, host string, path string"), otherwise)
    shared, key = spark.sparkContext.broadcast(rules), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = kept("trie", key, lambda: Trie(shared.value))
        for batch in batches:
            host, path = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            got = [trie.find(h or "", p or "") for h, p in zip(host, path, strict=True)]
            new = [pa.array([r and r.text for r in got], pa.string()), pa.array([r.verdict if r else otherwise for r in got], pa.string())]
            yield pa.record_batch([*batch.columns, *new], names=[*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(run, schema_of(parts, "rule string", "verdict string"))


def _judge_joined(parts: DataFrame, rules: DataFrame, otherwise: str) -> DataFrame:
    """By equal host suffixes and path prefixes, for any number of rules; distinct URLs are judged once.

    A URL asks for its suffixes of whole labels, and of its path for the prefixes of those lengths that rules have: as many
    numbers as the longest path has characters, at most. All that the join finds fits.
    """
    lengths = sorted(r.n for r in rules.select(F.char_length("path").alias("n")).distinct().collect())
    urls = parts.select(F.coalesce("host", F.lit("")).alias("h"), F.coalesce("path", F.lit("")).alias("p")).distinct()
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.withColumn("suffix", F.explode(F.array_union(suffixes, F.array(F.lit("")))))
    known = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length("p"))
    asked = asked.withColumn("prefix", F.explode(F.transform(known, lambda n: F.substr(F.col("p"), F.lit(1), n))))
    own = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict").groupBy("suffix", "prefix")
    own = own.agg(F.coalesce(F.max(F.when(F.col("verdict") == "block", F.lit("block"))), F.max("verdict")).alias("verdict"))
    rank = F.struct(F.char_length("suffix") + F.char_length("prefix"), F.char_length("suffix"))
    best = asked.join(own, ["suffix", "prefix"]).groupBy("h", "p").agg(F.max_by(F.struct(F.concat("suffix", "prefix").alias("rule"), "verdict"), rank).alias("won"))
    both = parts.join(best, (F.coalesce(parts["host"], F.lit("")) == F.col("h")) & (F.coalesce(parts["path"], F.lit("")) == F.col("p")), "left")
    return both.select(*[parts[c] for c in parts.columns], F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(otherwise)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_parts(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")
