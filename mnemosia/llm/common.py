"""Shared helpers: tables, the shared work folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows up to which a narrow table (a few longs a row) is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000

#: Rows of whole texts that Spark hands to Python at once; a task holds one such batch, and its copy in Arrow.
ARROW_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor reaches.

    Only a session on one machine (tests) gets a local folder where the setting is absent; a cluster must name one.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        base = context.getCheckpointDir()
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it has few rows, else as it is.

    df must be cheap to count (a stored table) and narrow."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def arrow_map(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches of whole texts that stay small: sets the session's limit where it is larger."""
    conf = df.sparkSession.conf
    limit = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if limit <= 0 or limit > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df.mapInArrow(function, schema)


def lower_ascii(c):
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
