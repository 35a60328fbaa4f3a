"""Salience: score, recalculation, boost, supersede."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .listing import NotFound


def salience(as_of: str) -> Column:
    """1 + 0.3 log2(accesses + 1) + up to 0.5 for use within 180 days + 2 if boosted - 0.5 if superseded, at least 0.1.

    An age is not floored: a time after as_of gives more than 0.5."""
    since = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.coalesce("last_accessed", "created_at").cast("timestamp"))
    return F.greatest(
        F.lit(0.1),
        1.0 + F.log2(F.col("access_count") + 1) * 0.3
        + F.greatest(F.lit(0.0), 1.0 - since / 86400.0 / 180.0) * 0.5
        + F.when(F.col("user_boosted"), 2.0).otherwise(0.0)
        - F.when(F.col("superseded_by").isNotNull(), 0.5).otherwise(0.0),
    )


def with_salience(nodes: DataFrame, as_of: str) -> DataFrame:
    return nodes.withColumn("salience_score", F.round(salience(as_of), 6))


def recalculate(nodes: DataFrame, as_of: str) -> DataFrame:
    """nodes with new scores and `changed`: by more than 1e-9."""
    new = salience(as_of)
    return nodes.withColumn("changed", F.coalesce(F.abs(F.col("salience_score") - new) > 1e-9, F.lit(True))).withColumn("salience_score", new)


def boost(nodes: DataFrame, node_id: str, as_of: str) -> DataFrame:
    if nodes.where(F.col("id") == node_id).isEmpty():
        raise NotFound(node_id)
    hit = F.col("id") == node_id
    marked = nodes.withColumn("user_boosted", F.when(hit, True).otherwise(F.col("user_boosted")))
    return marked.withColumn("salience_score", F.when(hit, salience(as_of)).otherwise(F.col("salience_score")))


def supersede(nodes: DataFrame, old: str, new: str, as_of: str) -> DataFrame:
    """Marks old as superseded by new and scores both anew."""
    if old == new:
        raise ValueError("a node cannot supersede itself")
    if nodes.where(F.col("id").isin(old, new)).select("id").distinct().count() < 2:
        raise NotFound(f"{old}, {new}")
    marked = nodes.withColumn("superseded_by", F.when(F.col("id") == old, F.lit(new)).otherwise(F.col("superseded_by")))
    return marked.withColumn("salience_score", F.when(F.col("id").isin(old, new), salience(as_of)).otherwise(F.col("salience_score")))
