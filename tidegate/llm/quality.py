"""Quality rules as a short-circuit cascade, with DataFrame functions alone.

A rule is SQL over the metrics of a text and its parts (``_q_text``, ``_q_words``, ``_q_lines``). ``estimate`` times each rule
on a bounded sample and counts what it rejects there; ``cascade`` asks the rules in order of rejections per second, in the
branches of one CASE, so that a rule is evaluated only for rows that those before let pass. So are the metrics that it
names, unless they are asked for as columns. ``failed_rule`` is the first that fails, ``kept`` says that none does. The order
changes which rule is named and what it costs, never what is kept.

Words are [^\\x20\\x09-\\x0D]+. A null or empty text has no words, no symbols, no repeated lines, and fails ``few_words``.
A null verdict of a rule is no rejection. Repeated rows are judged alike; an empty table gives no rows, and its rules keep
their order. Texts are taken whole. Columns are added, and a ValueError says where one of that name is there already.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

SPACE = r"[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Rows of the sample, and bytes of each at most: what rules cost and reject is read from no more than 32 MB.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 32_000
#: How often a rule is asked of each row of the sample while it is timed, so that it takes longer than a job's own time varies.
TIMES = 4
#: Rules that need no more than this on the sample cost the same; dearer ones are told apart by factors of four.
LEAST_SECONDS = 0.03


@dataclass(frozen=True)
class Rule:
    """rejects: SQL over metrics and parts."""

    name: str
    rejects: str


#: The first two are what the contract calls the base; the others leave prose alone. What most texts lack, or have in their
#: first words, is asked for first: ``AND`` leaves the rest alone where that decides.
BASE = [Rule("few_words", "n_words < 20"), Rule("repeated_words", "100 * n_repeat_words > 30 * n_words")]
RULES = [
    *BASE,
    Rule("symbols", "2 * n_symbols > n_words AND 10 * n_symbols > word_chars"),
    Rule("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("tables", "contains(_q_text, '|') AND 4 * (n_words - size(array_remove(_q_words, '|'))) > n_words"),
    Rule("shouting", "2 * regexp_count(_q_text, '[A-Z]') > word_chars"),
    Rule("cut_lines", rf"(contains(_q_text, '...') OR contains(_q_text, '…')) AND 10 * size(filter(_q_lines, l -> l RLIKE '([.]{{3}}|…){SPACE}*\\z')) > 3 * n_lines"),
    Rule("bullets", rf"10 * size(filter(_q_lines, l -> l RLIKE '^{SPACE}*[-*•]')) > 9 * n_lines"),
    Rule("few_distinct_words", "n_words >= 100 AND size(array_distinct(slice(_q_words, 1, 100))) < 30 AND size(array_distinct(_q_words)) < 30"),
    Rule("long_words", r"_q_text RLIKE '(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D]{1001}'"),
]


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once, under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """Words in windows found twice or more: equal grams are neighbours when sorted; only texts that have any are sorted."""
    grams = f"CASE WHEN size(h) >= {WINDOW} THEN transform(sequence(1, size(h) - {WINDOW - 1}), i -> xxhash64(slice(h, i, {WINDOW}))) ELSE array() END"
    same = "(j > 0 AND s[greatest(j - 1, 0)].g = x.g) OR (j + 1 < size(s) AND s[least(j + 1, size(s) - 1)].g = x.g)"
    places = f"array_sort(transform(filter(transform(s, (x, j) -> CASE WHEN {same} THEN x.i END), x -> x IS NOT NULL), x -> x))"
    covered = f"aggregate(transform(p, (x, j) -> CASE WHEN j + 1 < size(p) THEN least({WINDOW}, p[least(j + 1, size(p) - 1)] - x) ELSE {WINDOW} END), 0L, (a, x) -> a + x)"
    count = _let("s", "array_sort(transform(g, (g, i) -> struct(g AS g, i AS i)))", _let("p", places, covered))
    return _let("h", "transform(_q_words, w -> xxhash64(w))", _let("g", grams, f"CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE {count} END"))


METRICS = {
    "n_words": "cast(size(_q_words) AS bigint)",
    "word_chars": "cast(char_length(array_join(_q_words, '')) AS bigint)",
    "n_symbols": f"cast(regexp_count(_q_text, '{SYMBOLS}') AS bigint)",
    "n_lines": "cast(size(_q_lines) AS bigint)",
    "n_dup_lines": "cast(size(_q_lines) - size(array_distinct(_q_lines)) AS bigint)",
    "n_repeat_words": _repeat_words(),
}
_NAMES = re.compile(r"\b(" + "|".join(METRICS) + r")\b")


def _add(df: DataFrame, columns: dict) -> DataFrame:
    if clash := set(columns) & set(df.columns):
        raise ValueError(f"{sorted(clash)} clash with columns of the documents")
    return df.withColumns(columns)


def _parts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.expr(f"filter(split(_q_text, '{SPACE}+'), w -> w <> '')")
    lines = F.expr(rf"filter(split(_q_text, '\\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')")
    return _add(_add(docs, {"_q_text": text}), {"_q_words": words, "_q_lines": lines})


def _measured(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _add(parts, {c: F.expr(METRICS[c]) for c in columns})


def _rejects(rule: Rule, columns: Sequence[str]) -> str:
    """The rule's condition, with the metrics that are no columns in full."""
    return _NAMES.sub(lambda m: m[0] if m[0] in columns else f"({METRICS[m[0]]})", rule.rejects)


def metrics(docs: DataFrame, text_col: str = "text", columns: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words: one pass, no shuffle."""
    return _measured(_parts(docs, text_col), columns).drop("_q_text", "_q_words", "_q_lines")


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def cost(self) -> float:
        """Seconds in steps of a factor of four, so that only rules near a step can change places on a busy machine."""
        return LEAST_SECONDS * 4 ** round(log2(max(self.seconds, LEAST_SECONDS) / LEAST_SECONDS) / 2)

    @property
    def worth(self) -> float:
        return self.rejected / self.cost


def estimate(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", columns: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Each rule's cost and selectivity on at most ``sample_rows`` rows, best first, equally good ones in the order given.

    columns: metrics that are computed in any case, and cost a rule nothing. The sample is taken from the first partitions
    until there are enough rows, which a limit within a plan would take from all of them; rows and bytes of what comes to
    the driver are bounded. It is written once with its parts. A rule is timed twice, less what a job needs that only reads
    the sample, and the quicker run counts: the first also compiles. It is asked TIMES times of each row.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(text.alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).limit(sample_rows).collect()
    own = written(_measured(_parts(spark.createDataFrame(rows, "text string").coalesce(4), "text"), columns), "quality-sample")
    often = own.withColumn("_q_time", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(condition: str) -> tuple[float, int]:
        runs, n = [], 0
        for _ in range(2):
            began = time.perf_counter()
            n = often.agg(F.count_if(F.expr(condition))).first()[0]
            runs.append(time.perf_counter() - began)
        return min(runs), n // TIMES

    least = seconds("size(_q_words) + size(_q_lines) + length(_q_text) < 0")[0]
    out = []
    for rule in rules:
        took, rejected = seconds(_rejects(rule, columns))
        out.append(Estimate(rule, max(took - least, 0.0), rejected))
    discard(own)
    return sorted(out, key=lambda e: (-e.worth, e.cost))


def cascade(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", columns: Sequence[str] = ()) -> DataFrame:
    """The rows with ``failed_rule`` (null: none) and ``kept``, by rules in the order given, and with the metrics of ``columns``."""
    chain = " ".join(f"WHEN coalesce({_rejects(r, columns)}, false) THEN '{r.name}'" for r in rules)
    judged = _add(_measured(_parts(docs, text_col), columns), {"failed_rule": F.expr(f"CASE {chain} END")})
    return _add(judged, {"kept": F.expr("failed_rule IS NULL")}).drop("_q_text", "_q_words", "_q_lines")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rules = [e.rule for e in estimate(docs, RULES, columns=columns)]
    base = " OR ".join(f"({r.rejects})" for r in BASE)
    return cascade(docs, rules, columns=columns).select("doc_id", *columns, F.expr(base).alias("base_failed"), "kept")
