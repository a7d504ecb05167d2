"""The registered queries, beside their SQL or plain answers, on whole tables."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import connect, differences
from tests.llm import brute
from tests.llm.test_operators import prose
from tidegate.llm import bpe, toxicity
from tidegate.llm.common import ALNUM, table, word_chunks
from tidegate.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert not differences(spark, QUERIES[name], ORACLE_SQL[name], SF, connect(SF))


def test_contamination_and_near_duplicates(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert sorted(tuple(r) for r in QUERIES["op1_decontamination"](spark, SF).collect()) == sorted(brute.contamination(docs, items))
    want = brute.near_duplicates(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_near_duplicates"](spark, SF).collect()} == want


def test_shards(spark):
    """Sizes near equal, groups of equal texts whole, slots without gaps, on the whole table."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op3_shards"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and {r.law for r in rows} == {"bytes"}
    sums, shards = [0] * 24, {}
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode()))
        sums[r.shard] += r["size"]
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert max(sums) < 1.02 * min(sums) and all(len(v) == 1 for v in shards.values())
    for k in range(24):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_archives(spark):
    pages = [(r.page_id, r.html) for r in table(spark, SF, "pages").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op4_warc"](spark, SF).collect()}
    assert got == brute.revisits(pages)


def test_token_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, got = 0, {r.doc_id: r for r in QUERIES["op8_token_ids"](spark, SF).collect()}
    for r in table(spark, SF, "documents").orderBy("doc_id").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_byte_bpe(spark):
    library = bpe.load(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_bpe"](spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4")
        assert got[r.doc_id] == (len(ids), brute.sha(ids.tobytes()), brute.sha((r.text or "").encode()))


def test_toxicity_as_plain_ftrl(spark):
    """Scores are those of FTRL a coordinate at a time over the same places; over words as they are written, verdicts agree."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = sorted((r.doc_id, r.toxic) for r in table(spark, sf, "labels").collect() if not held(r.doc_id))

    def places(t):
        (c,) = word_chunks(pa.array([t]), ALNUM)
        return set(toxicity.features(c)[0].tolist())

    rows = QUERIES["op6_toxicity"](spark, sf).collect()
    assert len(rows) == len(texts) and all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.7) for r in rows)
    same, plain = (brute.ftrl([(texts[i], y) for i, y in labels], f) for f in (places, brute.toxic_features))
    assert all(abs(r.score - same(texts[r.doc_id])) < 1e-4 for r in rows)
    assert sum((r.score >= 0.5) != (plain(texts[r.doc_id]) >= 0.5) for r in rows) < 0.05 * len(rows)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = [r for r in QUERIES["op6_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in rows)
    right = [r for r in rows if labels[r.doc_id] == 1 and r.predicted == 1]
    wrong = [r for r in rows if labels[r.doc_id] == 0 and r.predicted == 1]
    assert len(right) > 0.6 * sum(labels[r.doc_id] for r in rows) and len(wrong) < 0.01 * len(rows)


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF).persist()
        if name != "token_ids":
            assert out.dtypes == docs.dtypes
        after = {r.doc_id: r for r in out.collect()}
        if name == "line_dedup":
            assert {i: r.text for i, r in after.items()} == {i: x[2] for i, x in brute.line_dedup(before).items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute.near_duplicates(before).items() if c == i}
        elif name == "decontamination":
            assert set(after) == {i for i, *_, bad in brute.contamination(before, items) if not bad}
        else:
            assert set(after) <= {i for i, _ in before}
        docs = out
    assert docs.count() > 0 and docs.where(F.col("n_tokens") < 0).isEmpty()


def test_pipeline_of_odd_rows(spark):
    """Null and repeated ids, texts without words, columns of the operators' own names; and no rows at all."""
    texts = [prose(120, k) for k in range(6)]
    long = "a line of forty characters or more that many documents have in common"
    rows = [(1, texts[0]), (2, texts[0]), (3, texts[1]), (3, texts[2]), (3, texts[2]), (None, texts[3]), (None, texts[4]), (None, None), (4, ""), (4, None), (5, " \n ")]
    rows += [(10 + k, f"{prose(60, 30 + k)}\n{long}\n{prose(60, 50 + k)}") for k in range(6)]
    names = ["id", "t", "n", "hits", "count", "score_", "label", "key", "last", "size"]
    df = spark.createDataFrame([(i, x, 7, *range(len(names))) for i, x in rows], "doc_id long, text string, n_chars int, " + ", ".join(f"{n} int" for n in names)).repartition(3)
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0, name
        docs = stage(spark, docs, SF).persist()
        if name != "token_ids":
            assert docs.columns == df.columns
        if name == "near_dedup":
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            for i, x in ((1, texts[0]), (3, texts[1]), (3, texts[2]), (None, texts[3]), (None, texts[4]), (None, None), (4, ""), (4, None), (5, " \n ")):
                assert kept.count((i, x)) == 1, (i, x)
            assert (2, texts[0]) not in kept
            assert sum(long in (x or "") for _, x in kept) == 1 and len(kept) == 9 + 6
    assert docs.count() == 15
