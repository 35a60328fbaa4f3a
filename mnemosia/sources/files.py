"""Readers and writers: catalog, exports, chunk tables, folders of texts, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Catalog:
    """Tables of one tenant under a folder, each Parquet partitioned by tenant_id: the filter prunes partitions."""

    spark: SparkSession
    path: str
    tenant: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("tenant_id") == self.tenant).drop("tenant_id")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.withColumn("tenant_id", F.lit(self.tenant)).write.mode("append").partitionBy("tenant_id").parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Replaces this tenant's rows only. rows must not read the same table."""
        writer = rows.withColumn("tenant_id", F.lit(self.tenant)).write.mode("overwrite").partitionBy("tenant_id")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{name}")


def write_export(nodes: DataFrame, edges: DataFrame, header: DataFrame, path: str) -> None:
    """header.json, nodes and edges as JSON lines under a folder."""
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_export(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(node_schema).json(f"{path}/nodes"), spark.read.schema(edge_schema).json(f"{path}/edges")


def chunk_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of stored chunks (id, path, start_line, end_line, text): a memory_chunk node for each,
    a NEXT_CHUNK edge from each to the next of its file."""
    parts = F.split("path", "/")
    place = F.when(F.size(parts) > 1, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.col("path"))
    label = F.concat(place, F.lit(" L"), F.col("start_line"), F.lit("-"), F.col("end_line"))
    nodes = chunks.select(F.concat(F.lit("chunk:"), F.substring("id", 1, 16)).alias("id"), F.lit("memory_chunk").alias("type"), label.alias("label"), F.to_json(F.struct("path", "text")).alias("properties"), "path", "start_line")
    nxt = F.lead("id").over(Window.partitionBy("path").orderBy("start_line", "id"))
    edges = nodes.select(F.col("id").alias("source"), nxt.alias("target"), F.lit("NEXT_CHUNK").alias("relation")).where("target IS NOT NULL")
    return nodes.drop("path", "start_line"), edges


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: each file whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def changed_files(spark: SparkSession, folder: str, manifest: DataFrame | None, glob: str = "*.md") -> DataFrame:
    """path, length, modificationTime, text of the folder's files that the manifest (path, length, modificationTime) lacks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    if manifest is not None:
        files = files.join(manifest, ["path", "length", "modificationTime"], "left_anti")
    return files.select("path", "length", "modificationTime", F.decode("content", "UTF-8").alias("text"))


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], attempts: int = 3) -> DataFrame:
    """id, embedding for rows (id, text) by a function over lists of texts, tried up to `attempts` times a batch; a batch that fails all gives nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = [None] * len(frame)
            for k in range(attempts):
                try:
                    vectors = embedder(frame["text"].fillna("").tolist())
                    break
                except OSError:
                    if k + 1 == attempts:
                        vectors = [None] * len(frame)
            yield pd.DataFrame({"id": frame["id"], "embedding": vectors})

    return rows.select("id", "text").mapInPandas(run, "id string, embedding array<float>")
