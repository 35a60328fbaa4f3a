"""Quality rules: a ledger of rule bits and measurements.

Every text is measured once. Each rule sets one bit of `fail_bits` when it
fails. Policies are bit masks over that ledger, so a policy, a new version of it
or an ablation needs no second look at the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow_map, stored, table
from .textnp import Texts, ngrams

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: (name, failure as SQL over the measures), in bit order; bits are never reused.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 50 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: a document is dropped if any of these rules failed.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "short_words"],
}


def policy_table(spark: SparkSession) -> DataFrame:
    """policy, rules, mask of every policy."""
    return spark.createDataFrame([(p, POLICIES[p], mask(p)) for p in POLICIES], "policy string, rules array<string>, mask long")


def fail_bits() -> Column:
    """One bit for each rule that fails, over the measures."""
    bits = F.lit(0).cast("long")
    for name, failed in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _repeats(words: np.ndarray) -> int:
    """Words within windows of 8 that occur twice or more."""
    grams = ngrams(words, WINDOW)
    if len(grams) < 2:
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[inverse] > 1)
    if not len(hit):
        return 0
    return int(np.minimum(WINDOW, np.diff(hit, append=hit[-1] + WINDOW)).sum())


def _measure(texts: Texts) -> dict[str, list[int]]:
    starts, ends, first = texts.words()
    hashes = texts.hashes(starts, ends)
    chars = np.concatenate([[0], np.cumsum((texts.buf & 0xC0) != 0x80)])
    in_words = np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[texts.buf])])
    breaks = np.flatnonzero(texts.buf == 10)
    out: dict[str, list[int]] = {m: [] for m in MEASURES}
    for i in range(texts.n):
        a, b, lo, hi = texts.offsets[i], texts.offsets[i + 1], first[i], first[i + 1]
        own = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)]
        line_starts, line_ends = np.append(a, own + 1), np.append(own, b)
        full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        lines = texts.hashes(line_starts[full], line_ends[full]) if full.sum() > 1 else ()
        out["n_words"].append(int(hi - lo))
        out["word_chars"].append(int(in_words[hi] - in_words[lo]))
        out["n_symbols"].append(int(symbols[b] - symbols[a]))
        out["n_dup_lines"].append(len(lines) - len(np.unique(lines)))
        out["n_lines"].append(int(full.sum()))
        out["n_repeat_words"].append(_repeats(hashes[lo:hi]))
    return out


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> doc_id and the measures."""
    for batch in batches:
        for at, end, texts in Texts.slices(batch.column(1)):
            measures = _measure(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *[pa.array(measures[m], pa.int64()) for m in MEASURES]], ["doc_id", *MEASURES])


def _measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row with a field text) -> row and the measures."""
    for batch in batches:
        rows = batch.column(0)
        for at, end, texts in Texts.slices(rows.field("text")):
            measures = _measure(texts)
            yield pa.RecordBatch.from_arrays([rows.slice(at, end - at), *[pa.array(measures[m], pa.int64()) for m in MEASURES]], ["row", *MEASURES])


def rule_ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and fail_bits of every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no words. Repeated rows stay repeated."""
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), _measure_batches, schema).withColumn("fail_bits", fail_bits())


def passes(policy: str, bits: Column | None = None) -> Column:
    """True where no rule of the policy failed."""
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_only, kept_without of each rule of a policy: documents that
    fail it, those that no other rule of the policy drops, and how many documents the
    policy without it would keep. One pass, one row a task is shuffled."""
    whole = F.lit(mask(policy)).cast("long")
    bits = F.col("fail_bits").bitwiseAND(whole)
    counts = []
    for name in POLICIES[policy]:
        bit = F.lit(BIT[name]).cast("long")
        counts += [
            F.count_if(bits.bitwiseAND(bit) != 0).alias(f"{name}__failed"),
            F.count_if(bits == bit).alias(f"{name}__only"),
            F.count_if(bits.bitwiseAND(F.lit(mask(policy) & ~BIT[name]).cast("long")) == 0).alias(f"{name}__kept"),
        ]
    rows = ", ".join(f"'{n}', `{n}__failed`, `{n}__only`, `{n}__kept`" for n in POLICIES[policy])
    return ledger.agg(*counts).selectExpr(f"stack({len(POLICIES[policy])}, {rows}) AS (rule, n_failed, n_only, kept_without)")


def op5_quality_rules(spark: SparkSession, sf_dir: str, policy: str = "v1") -> DataFrame:
    return rule_ledger(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"),
        (passes("base") & passes(policy)).alias("kept"),
        "fail_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy without each of its rules, and as it is, from one stored ledger of all documents."""
    ledger = stored(rule_ledger(table(spark, sf_dir, "documents")), "ledger")
    found = None
    for policy in POLICIES:
        rows = ablations(ledger, policy).select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_only", "kept_without")
        found = rows if found is None else found.unionByName(rows)
    masks = policy_table(spark).select("policy", "mask")
    kept = ledger.groupBy("fail_bits").agg(F.count("*").alias("n")).join(F.broadcast(masks), F.col("fail_bits").bitwiseAND(F.col("mask")) == 0).groupBy("policy").agg(F.sum("n").alias("kept"))
    return found.join(kept, "policy", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, policy: str = "v1") -> DataFrame:
    """The rows of docs that the policy keeps, with their columns; each row is judged on its own text."""
    names = [f for f in docs.columns]
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    schema = StructType([StructField("row", packed.schema["row"].dataType), *[StructField(m, LongType()) for m in MEASURES]])
    measured = arrow_map(packed, _measure_rows, schema)
    return measured.where(passes(policy, fail_bits()) & passes("base", fail_bits())).select("row.*")


#: SQL for the ledger; the words and windows are lists.
LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
h AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(j - i, 8)))::BIGINT AS n FROM h GROUP BY 1),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (100 * n_symbols > 50 * n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 60 * n_lines)::BIGINT + 16 * (word_chars > 25 * n_words)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT AS fail_bits FROM m)
"""
ORACLE = LEDGER_SQL + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b"
ABLATIONS_SQL = LEDGER_SQL + r""", p(policy, rule, bit, mask) AS (VALUES ('base', 'few_words', 1, 3), ('base', 'repeated_windows', 2, 3),
  ('v1', 'few_words', 1, 63), ('v1', 'repeated_windows', 2, 63), ('v1', 'symbols', 4, 63), ('v1', 'duplicate_lines', 8, 63), ('v1', 'long_words', 16, 63), ('v1', 'short_words', 32, 63))
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_only,
  count(*) FILTER (fail_bits & mask & ~bit = 0) AS kept_without, count(*) FILTER (fail_bits & mask = 0) AS kept
FROM p, b GROUP BY policy, rule"""
