"""WARC archives, compressed with Zstandard: a dictionary in the leading skippable frame, then a frame a record.

``write_archives`` writes pages as response records; a page whose payload equals that of another becomes a revisit record
that refers to the one of the largest page_id. ``read_archives`` gives the records back, those of archives written elsewhere
too, and checks each: one record a frame, a version line, the headers that its type needs, block and payload lengths, and
the digest of each payload that has one.

A null html is an empty payload. An empty table gives no archive. A file is closed at FILE_BYTES, so that it has no more than
these and one record, which must stay below the 2 GB that Spark reads as one value. Other columns are not read. Rows that share the largest page_id of their payload are all responses; a null page_id is
never the largest, and where there is no other, all are responses. A null or odd URL is percent-encoded. The dictionary is
trained on at most ``sample`` pages (DICT_SAMPLE, of DICT_CHARS characters each); where that fails, there is none.
"""

from __future__ import annotations

import base64
import hashlib
import io
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import shared_dir, small_batches, table, written

SKIPPABLE = 0x184D2A5D
#: Any of 16 magic numbers begins a skippable frame; this is the first.
SKIPPABLES = 0x184D2A50
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICT_SAMPLE, DICT_CHARS, DICT_BYTES = 400, 8192, 64 << 10
FILE_BYTES = 16 << 20
WINDOW = 64 << 10
#: Digests of repeated payloads that are sent to the pages at most (28 bytes each); beyond, pages are shuffled to them.
MAX_DIGESTS = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; of a revisit, the block has only the HTTP headers."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    heads = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"), ("WARC-Date", date)]
    heads += [("WARC-Target-URI", urllib.parse.quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._"))]
    heads += [("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    heads += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []
    heads += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        head, mark, body = self.block.partition(b"\r\n\r\n")
        if not mark or not head.startswith(b"HTTP/"):
            raise ValueError("the block is no HTTP response")
        return _headers(head.split(b"\r\n")[1:]), body


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for x in lines:
        name, mark, value = x.partition(b":")
        if not mark or not name or name != name.strip():
            raise ValueError(f"no header: {x[:80]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return out


def parse(data: bytes) -> Record:
    """The one record that ``data`` holds; ValueError if it isn't just that."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not mark or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"no WARC record: {data[:40]!r}")
    headers = _headers(lines)
    if lacking := [k for k in NEEDED if k not in headers]:
        raise ValueError(f"headers are missing: {lacking}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {headers['content-length']}, and {len(rest)} bytes follow")
    return Record(headers, rest[:-4])


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each frame of an archive, with the dictionary of its leading skippable frame; others are skipped."""
    at, own = 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == SKIPPABLE:
        n = int.from_bytes(data[4:8], "little")
        if len(data) < 8 + n:
            raise ValueError("the dictionary's frame is cut off")
        own, at = data[8 : 8 + n], 8 + n
        if own[:4] == ZSTD_MAGIC:
            own = zstandard.ZstdDecompressor().decompress(own)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own) if own else None)
    view = memoryview(data)
    while at < len(data):
        if SKIPPABLES <= int.from_bytes(view[at : at + 4], "little") < SKIPPABLES + 16:
            at += 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if at > len(data):
                raise ValueError("a skippable frame is cut off")
            continue
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut off")
            piece = view[at : at + WINDOW]
            try:
                out.append(frame.decompress(piece))
            except zstandard.ZstdError as e:
                raise ValueError(f"no frame at byte {at}: {e}") from e
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(out)


def dictionary_frame(own: bytes) -> bytes:
    return SKIPPABLE.to_bytes(4, "little") + len(own).to_bytes(4, "little") + own


def train(pages: DataFrame, html_col: str, sample: int = DICT_SAMPLE) -> bytes:
    """A dictionary from at most ``sample`` pages' beginnings; empty where too little is there."""
    rows = pages.where(F.length(html_col) > 0).select(F.substring(html_col, 1, DICT_CHARS).alias("x")).limit(sample).collect()
    try:
        return zstandard.train_dictionary(DICT_BYTES, [r.x.encode() for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def with_refers_to(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: null for responses.

    Digests and ids are grouped. The pages stay where they are while the digests that are repeated are few enough.
    """
    rows = pages.withColumn("own", F.unhex(F.sha1(F.coalesce("html", F.lit("")))))
    again = rows.groupBy("own").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = written(again, "payloads-again")
    again = F.broadcast(again) if again.count() <= MAX_DIGESTS else again
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(again, "own", "left").select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", to: str | None = None, file_bytes: int = FILE_BYTES, sample: int = DICT_SAMPLE, level: int = 3) -> DataFrame:
    """Writes ``*.warc.zst`` files under ``to`` (else in the shared folder); returns file, n_records, written as well.

    A task that runs again writes files of other names; only those of the returned rows count.
    """
    spark = pages.sparkSession
    narrow = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    to = to or shared_dir(spark, "warc")
    files.make_dir(to)
    own = train(narrow, "html", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(own) if own else None, write_checksum=True)
        out, n, names, counts = io.BytesIO(), 0, [], []

        def close() -> None:
            names.append(f"{uuid.uuid4().hex}.warc.zst")
            counts.append(n)
            files.write_bytes(f"{to}/{names[-1]}", out.getvalue())

        for batch in small_batches(batches, "html"):
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not n and own:
                    out.write(dictionary_frame(own))
                out.write(packer.compress(record(page_id, url, (html or "").encode(), refers_to)))
                n += 1
                if out.tell() >= file_bytes:
                    close()
                    out, n = io.BytesIO(), 0
        if n:
            close()
        yield pa.record_batch([pa.array([f"{to}/{x}" for x in names], pa.string()), pa.array(counts, pa.int64())], names=["file", "n_records"])

    return written(with_refers_to(narrow).mapInArrow(run, "file string, n_records long"), "warc-manifest")


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, record_id string"
ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))])


def _page(urn: str | None) -> int | None:
    """The page of a record id as written here; null for others."""
    own = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(own) if own.removeprefix("-").isdecimal() and urn == f"<urn:page:{own}>" else None


def row_of(x: Record) -> tuple:
    """The row of a record; ValueError if its payload isn't what its headers say.

    The payload of a response is what follows its HTTP headers, of a revisit none, else the block. A length that isn't
    stated is that of the payload, and null for revisits; of a transfer in chunks it isn't compared.
    """
    head, payload = x.http() if x.kind in ("response", "revisit") and (x.block.startswith(b"HTTP/") or x.kind == "response") else ({}, x.block)
    own, named = x.headers.get("warc-payload-digest"), x.headers["warc-record-id"]
    size = int(head["content-length"]) if head.get("content-length", "").isdecimal() and "transfer-encoding" not in head else None
    if x.kind == "revisit":
        if payload:
            raise ValueError(f"the revisit {named} has a payload")
    else:
        if size not in (None, len(payload)) or (own and own.lower().startswith("sha1:") and len(own) == 37 and digest(payload) != own[5:].upper()):
            raise ValueError(f"the payload of {named} isn't what its headers say")
        size = len(payload)
    bare = own.partition(":")[2] if own and ":" in own else own
    return _page(named), x.headers.get("warc-target-uri"), x.kind, _page(x.headers.get("warc-refers-to")), bare, size, None if x.kind == "revisit" else payload, named


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of the archives of a folder, written elsewhere: file, n_records (null: not known)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return found.select(F.concat(F.lit(folder.rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1)).alias("file"), F.lit(None).cast("long").alias("n_records"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of a manifest's files. ``payload`` is null for revisits; its digest and length are of the full payload.

    The files may be in several folders; a listed one that isn't there is an error, as is another number of records than
    the manifest states. Record ids that aren't pages' as written here give a null page_id, and are in record_id.
    """
    spark = manifest.sparkSession
    folder, name = F.regexp_replace("file", "/[^/]*$", "").alias("folder"), lambda c: F.element_at(F.split(c, "/"), -1).alias("name")
    folders = sorted(r.folder for r in manifest.select(folder).distinct().collect())
    if not folders:
        return spark.createDataFrame([], RECORDS)
    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst")
    found = reduce(DataFrame.union, [source.load(x).select(F.lit(x).alias("folder"), name("path"), "content") for x in folders])
    listed = manifest.select(folder, name("file"), "n_records")
    gone = listed.join(found.select("folder", "name"), ["folder", "name"], "left_anti").limit(3).collect()
    if gone:
        raise ValueError(f"the manifest lists archives that aren't there: {', '.join(f'{r.folder}/{r.name}' for r in gone)}")
    content = found.join(listed, ["folder", "name"]).select("name", "n_records", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in rows], ARROW)
        for batch in batches:
            for i in range(batch.num_rows):
                name, expected, data = (batch.column(k)[i].as_py() for k in range(3))
                out, n, held = [], 0, 0
                for frame in frames(data):
                    try:
                        out.append(row_of(parse(frame)))
                    except ValueError as e:
                        raise ValueError(f"{name}, record {n}: {e}") from e
                    n, held = n + 1, held + len(frame)
                    if held > 8 << 20:
                        yield batch_of(out)
                        out, held = [], 0
                if expected not in (None, n):
                    raise ValueError(f"{name} has {n} records, not {expected}")
                yield batch_of(out)

    return content.mapInArrow(run, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
