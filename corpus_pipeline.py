"""A corpus pipeline over `documents`: five stages, each stored as Parquet and read again.

Quality rules reject documents, near-dedup leaves one of each group,
decontamination rejects documents with benchmark windows, secrets are masked in
the texts, and what is left is encoded. All stages but the last return the
columns of documents; the last returns doc_id, n_tokens, ids, decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemosia.llm.bpe import encode_stage
from mnemosia.llm.common import stored, table
from mnemosia.llm.decontaminate import decontaminate_stage
from mnemosia.llm.minhash import near_dedup_stage
from mnemosia.llm.quality import quality_stage
from mnemosia.llm.secrets import redact_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("secret_scan", redact_stage),
    ("bpe_encode", encode_stage),
]

#: SQL cannot encode; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
