"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, lines, neardup, packing, quality, sql, tokens, toxicity, urls, warc
from .common import ship


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_decontamination": _shipped(decontaminate.op1_decontamination),
    "op2_near_duplicates": _shipped(neardup.op2_near_duplicates),
    "op3_shards": _shipped(packing.op3_shards),
    "op4_warc": _shipped(warc.op4_warc),
    "op5_url_filter": _shipped(urls.op5_url_filter),
    "op6_toxicity": _shipped(toxicity.op6_toxicity),
    "op7_quality_rules": _shipped(quality.op7_quality_rules),
    "op8_token_ids": _shipped(tokens.op8_token_ids),
    "op9_bpe": _shipped(bpe.op9_bpe),
    "op10_line_dedup": _shipped(lines.op10_line_dedup),
}

ORACLE_SQL = {
    "op1_decontamination": sql.CONTAMINATION,
    "op2_near_duplicates": sql.NEAR_DUPLICATES,
    "op4_warc": sql.ARCHIVES,
    "op5_url_filter": sql.URL_FILTER,
    "op7_quality_rules": sql.QUALITY_RULES,
    "op10_line_dedup": sql.LINE_DEDUP,
}
