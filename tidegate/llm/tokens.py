"""Token ids in binary shards, with a minimal perfect hash index from document keys to places in them.

A shard is a payload of raw ids (16 bits each where the vocabulary allows, else 32; documents one after another) and an
index: a minimal perfect hash of (doc_id, occurrence) with, by slot, a 64-bit fingerprint, the first id's position and the
number of ids; and the keys in payload order. Shards follow doc_id, so a dataset is in ascending order as a whole; a
lookup reads one index and one run of the payload.

Null and empty texts have the end id alone. A null doc_id sorts first. Rows of equal id keep an entry each, in the order
of their texts, as occurrence 0, 1 and so on. A task that runs again writes new files; the manifest has those that count.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, mph
from .common import LOWER, U64, id_text, mix, ranges, shared_dir, small_batches, table, text_buffers, written

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MARK = b"~"
#: Stems kept with their ids in each Python worker, of at most so many bytes; as many older ones are kept besides. So many
#: words of a batch are put together from them at once.
CACHED, CACHED_WORDS, CACHED_BYTES = 400_000, 1 << 18, 64
JOINED = 512
#: Text taken at once: the more, the fewer words are met again.
TAKEN = 8 << 20
#: After these, ASCII marks other than an apostrophe are tokens of their own.
STEM_ENDS = np.zeros(256, bool)
STEM_ENDS[48:58] = STEM_ENDS[97:123] = True
ENDINGS = np.zeros(256, bool)
ENDINGS[33:127] = ~(STEM_ENDS | np.roll(STEM_ENDS, -32))[33:127]
ENDINGS[ord("'")] = False
NULL_ID = -(1 << 63)


def _binary(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])


class WordEncoder:
    """Encodes texts by their words, for tokenizers that drop white space, lower-case, and merge within words alone.

    ASCII white space never joins a token there, so a text's ids are its words' ids. Each word of a batch is looked up once:
    as its stem (lower-cased, without the ASCII marks at its end) and those marks, which the library keeps apart from
    letters and digits. A stem goes through the library once while it is cached. What may hold a special token stays whole
    and keeps its case, since the library looks for those before it lower-cases. New stems go together, set apart by a mark
    of one id, which is checked at the start. Stems of letters in composed form are lower-cased here and need no splitting,
    so these steps are left out for them, and for ASCII letters the mapping of bytes too.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii = Tokenizer(self.letters.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        marks = [self._ids(t, MARK.decode()).tolist() for t in (self.tokenizer, self.letters, self.ascii)]
        self.mark = marks[0][0] if len(marks[0]) == 1 and marks[0] == marks[1] == marks[2] else None
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _alone(self, stem: bytes) -> bytes:
        return self._ids(self.tokenizer, stem.decode("utf-8")).tobytes()

    def _ask(self, stems: list[bytes]) -> dict[bytes, bytes]:
        out, asked = {}, {self.ascii: ([], []), self.letters: ([], []), self.tokenizer: ([], [])}
        for w in stems:
            if self.mark is None or len(w) > CACHED_BYTES:
                out[w] = self._alone(w)
                continue
            if w.isalpha():  # ASCII letters
                tokenizer, text = self.ascii, w.decode("ascii")
            elif MARK in w or b"<|" in w:
                out[w] = self._alone(w)
                continue
            else:
                tokenizer, text = self.tokenizer, w.decode("utf-8")
                # the library lower-cases a character at a time, so a sigma at the end as any other
                if not w.isascii() and (small := text.lower()).isalpha() and "Σ" not in text and unicodedata.is_normalized("NFC", text):
                    tokenizer, text = self.letters, small
            asked[tokenizer][0].append(w)
            asked[tokenizer][1].append(text)
        size, between = self.dtype.itemsize, f" {MARK.decode()} "
        for tokenizer, (words, texts) in asked.items():
            for a in range(0, len(words), JOINED):
                part = words[a : a + JOINED]
                ids = self._ids(tokenizer, between.join(texts[a : a + JOINED]))
                ends = (np.append(np.flatnonzero(ids == self.mark), len(ids)) * size).tolist()
                if len(ends) != len(part):
                    out.update((w, self._alone(w)) for w in part)
                    continue
                raw, at = ids.tobytes(), 0
                for w, end in zip(part, ends, strict=True):
                    out[w] = raw[at:end]
                    at = end + size
        return out

    def _of_stems(self, stems: list[bytes]) -> list[bytes]:
        known, old = self.cache, self.old
        new = [s for s in stems if s not in known]
        known.update({s: old[s] for s in new if s in old})
        fresh = self._ask([s for s in new if s not in old])
        known.update(fresh)
        ids = [known[s] for s in stems]
        for s in fresh:
            if len(s) > CACHED_BYTES:
                del known[s]
        if len(known) > CACHED:
            self.old, self.cache = known, {}
        return ids

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after another, and how many each has."""
        data, offs = text_buffers(words)
        starts, ends, at = offs[:-1], offs[1:], np.arange(len(data))
        special = np.zeros(len(starts), bool)
        special[np.searchsorted(ends, np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))), "right")] = True
        small = np.where(np.repeat(special, ends - starts), data, LOWER[data])
        last = np.append(-1, np.maximum.accumulate(np.where(ENDINGS[small], -1, at)))[ends]  # the last byte that is no ending
        cut = np.where((last >= starts) & STEM_ENDS[np.append(small, 0)[last]] & ~special, last + 1, ends)
        both = np.append(np.stack([starts, cut], 1).ravel(), len(data))
        pieces = _binary(small, both).dictionary_encode()
        own = self._of_stems(pieces.dictionary.to_pylist())
        n = np.fromiter(map(len, own), np.int64, len(own)) // self.dtype.itemsize
        ids, k = np.frombuffer(b"".join(own), self.dtype), pieces.indices.to_numpy()
        return ids[ranges((np.cumsum(n) - n)[k], n[k])], n[k].reshape(-1, 2).sum(1)

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[Iterator[np.ndarray], np.ndarray]:
        """The ids of a string column's texts, each with the end id, in runs one after another; and how many each has."""
        split = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        words, offs = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
        offs -= offs[0]
        ids, n = self._of_words(words.dictionary)
        k = words.indices.to_numpy()
        if end_id is not None:
            k = np.insert(k, offs[1:], len(n))
            ids, n, offs = np.append(ids, self.dtype.type(end_id)), np.append(n, 1), offs + np.arange(len(offs))
        starts = np.cumsum(n) - n
        parts = [k[a : a + CACHED_WORDS] for a in range(0, len(k), CACHED_WORDS)]
        total = np.append(0, np.cumsum(n[k]))
        return (ids[ranges(starts[x], n[x])] for x in parts), np.diff(total[offs])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        runs, n = self.encode_column(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        raw, ends = b"".join(x.tobytes() for x in runs), (np.cumsum(n) * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def key_hash(ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(ids.view(U64) + U64(0x9E3779B97F4A7C15) * (occurrence.astype(U64) + U64(1)))


def key_print(ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(~ids.view(U64) * U64(0xD1342543DE82EF95) + occurrence.astype(U64))


def occurrences(ids: np.ndarray) -> np.ndarray:
    """For ids in order: 0 for the first of each, then 1 and so on."""
    if not len(ids):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))


MANIFEST = "part int, payload string, index string, first_id long, last_id long, n_docs long, n_ids long, width int"


def write_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = END_ID, shards: int | None = None, to: str | None = None) -> DataFrame:
    """Writes shards under ``to`` (a URI; else in the shared folder); returns their manifest, written as well."""
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    to = to or shared_dir(spark, "token-ids")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files.make_dir(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, name = encoder(tokenizer), uuid.uuid4().hex
        keys, sizes, out = [], [], None
        for batch in small_batches(batches, "text", TAKEN):
            if out is None:
                fs, path = files.opened(f"{to}/{name}.ids")
                out = fs.open_output_stream(path, compression=None)
            runs, n = words.encode_column(batch.column(1), end_id)
            for x in runs:
                out.write(x.tobytes())
            sizes.append(n)
            keys.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        ids, n = np.concatenate(keys), np.concatenate(sizes)
        occurrence, start = occurrences(ids), np.cumsum(n) - n
        h = key_hash(ids, occurrence)
        f = mph.MinimalPerfectHash.build(h)
        order = np.argsort(f.slots(h))
        arrays = {"print": key_print(ids, occurrence)[order], "start": start[order], "length": n[order], "keys": ids}
        files.write_bytes(f"{to}/{name}.index", mph.pack(arrays, f))
        row = [0, f"{to}/{name}.ids", f"{to}/{name}.index", int(ids[0]), int(ids[-1]), len(ids), int(n.sum()), words.dtype.itemsize]
        yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, row, strict=True))], schema=ARROW)

    ordered = id_text(docs, id_col, text_col).repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(ordered.mapInArrow(run, MANIFEST), "token-manifest")


ARROW = pa.schema([(n, {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}[t]) for n, t in (x.split() for x in MANIFEST.split(", "))])
FIELDS = ARROW.names


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest's shards in order of their documents, with the number of ids before each. One row a shard."""
    rows = sorted((r.asDict() for r in manifest.collect()), key=lambda r: (r["first_id"], r["last_id"]))
    base = 0
    for k, r in enumerate(rows):
        r["part"], r["base"] = k, base
        base += r["n_ids"]
    return manifest.sparkSession.createDataFrame([tuple(r[c] for c in [*FIELDS, "base"]) for r in rows], f"{MANIFEST}, base long")


class Shard:
    def __init__(self, payload: str, index: str, width: int):
        self.payload, self.width = payload, width
        self.mph, self.arrays = mph.unpack(files.read_bytes(index))

    def places(self, ids: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are in the shard, their first positions and numbers of ids."""
        slot = self.mph.slots(key_hash(ids, occurrence))
        if not self.mph.size:
            return np.zeros(len(ids), bool), slot, slot
        found = (slot >= 0) & (self.arrays["print"][slot] == key_print(ids, occurrence))
        return found, self.arrays["start"][slot], self.arrays["length"][slot]


def _null_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def read_ids(manifest: DataFrame, group_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, unsigned 32 bits) of every document.

    Each key is looked up in its shard's index; payloads are read from the front in runs of about ``group_bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(r["payload"], r["index"], r["width"])
                keys = shard.arrays["keys"]
                found, start, n = shard.places(keys, occurrences(keys))
                if not found.all() or len(keys) != r["n_docs"]:
                    raise ValueError(f"index and keys of {r['index']} differ")
                offs = np.append(start, r["n_ids"])
                fs, path = files.opened(r["payload"])
                with fs.open_input_file(path) as f:
                    if f.size() != r["n_ids"] * r["width"]:
                        raise ValueError(f"{r['payload']} has {f.size()} bytes, not {r['n_ids'] * r['width']}")
                    a = 0
                    while a < len(keys):
                        b = max(a + 1, int(np.searchsorted(offs, offs[a] + group_bytes // 4, "right")) - 1)
                        ids = np.frombuffer(f.read_at(int(offs[b] - offs[a]) * shard.width, int(offs[a]) * shard.width), f"<u{shard.width}").astype("<u4")
                        cut = (offs[a : b + 1] - offs[a]).tolist()
                        own = [ids[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)]
                        yield pa.record_batch([_null_ids(keys[a:b]), pa.array(start[a:b] + r["base"]), pa.array(n[a:b]), pa.array(own, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                        a = b

    at = placed(manifest)
    return at.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids of the keys' documents (occurrence 0); keys that aren't there have no row.

    Keys go to the shards whose bounds hold them, read in each task from the one row a shard of the manifest.
    """
    shards = [(r["first_id"], r["last_id"], r["payload"], r["index"], r["width"]) for r in sorted(placed(manifest).collect(), key=lambda r: r["part"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, Shard] = {}
        firsts = np.array([s[0] for s in shards])
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            at = np.searchsorted(firsts, ids, "right") - 1
            for k in np.unique(at[at >= 0]):
                if k not in opened:
                    opened.clear()  # rows come sorted: one index at a time
                    opened[k] = Shard(*shards[k][2:])
                shard, own = opened[k], ids[at == k]
                found, start, n = shard.places(own, np.zeros(len(own), np.int64))
                fs, path = files.opened(shard.payload)
                with fs.open_input_file(path) as f:
                    got = [np.frombuffer(f.read_at(int(y) * shard.width, int(x) * shard.width), f"<u{shard.width}").astype("<u4").tobytes() for x, y in zip(start[found], n[found], strict=True)]
                yield pa.record_batch([_null_ids(own[found]), pa.array(n[found]), pa.array(got, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    ids = keys.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).distinct()
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ids.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_ids(write_ids(table(spark, sf_dir, "documents")))
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
