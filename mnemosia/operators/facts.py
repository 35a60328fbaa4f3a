"""Facts: patches, consolidation, beliefs, history.

Evidence is a long table (node_id, property, value (canonical JSON text),
source, ts, confidence); beliefs are grouped from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTESTED_DELTA = 0.15
INTERNAL_KEYS = ["_fact_evidence", "_fact_updates", "_fact_beliefs"]


def merge_properties(old: Column, patch: Column) -> Column:
    """Maps of JSON text: keys of the patch replace, those with the JSON null go."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key(patch, k), F.lit(False)))
    new = F.map_filter(F.coalesce(patch, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != "null"))
    return F.map_concat(kept, new)


def claims(evidence: DataFrame, current: DataFrame) -> DataFrame:
    """node_id, property, value, confidence, evidence_count, last_observed, sources, place, status, preferred, ...

    Claims are the distinct values of a property. They are ordered by mean confidence (1 where
    none is given), number, being the current value, latest observation and value; then the
    current value changes places with the first. current: node_id, property, value."""
    grouped = evidence.groupBy("node_id", "property", "value").agg(
        F.least(F.greatest(F.avg(F.coalesce("confidence", F.lit(1.0))), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.count("*").alias("evidence_count"),
        F.max(F.coalesce("ts", F.lit(""))).alias("last_observed"),
        F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source")))).alias("sources"),
    )
    now = current.select("node_id", "property", F.col("value").alias("current"))
    met = grouped.join(now, ["node_id", "property"], "left").withColumn("has_current", F.col("current").isNotNull()).withColumn("is_current", F.coalesce(F.col("value") == F.col("current"), F.lit(False)))
    own = Window.partitionBy("node_id", "property")
    # rounded, as is the gap below, since the last digits of a mean follow the order of its terms
    order = own.orderBy(F.desc(F.round("confidence", 12)), F.desc("evidence_count"), F.desc("is_current"), F.desc("last_observed"), F.asc("value"))
    placed = met.withColumn("n", F.row_number().over(order)).withColumn("swap", F.max(F.when(F.col("is_current"), F.col("n"))).over(own))
    placed = placed.withColumn("place", F.when(F.col("swap").isNull() | ~F.col("n").isin(1) & (F.col("n") != F.col("swap")), F.col("n")).when(F.col("n") == F.col("swap"), 1).otherwise(F.col("swap")))
    first = F.max(F.when(F.col("place") == 1, F.col("confidence"))).over(own)
    second = F.max(F.when(F.col("place") == 2, F.col("confidence"))).over(own)
    state = F.when(F.col("has_current") & second.isNotNull() & (F.round(first - second, 12) < CONTESTED_DELTA), "contested").when(~F.col("has_current"), "superseded").otherwise("supported")
    out = placed.withColumn("belief_status", state)
    status = F.when((F.col("place") == 1) & F.col("has_current"), F.col("belief_status")).when((F.col("belief_status") == "contested") & (F.col("place") <= 2), "contested").otherwise("superseded")
    return out.withColumn("status", status).withColumn("preferred", F.col("place") == 1).drop("n", "swap", "current")


def beliefs(evidence: DataFrame, current: DataFrame) -> DataFrame:
    """node_id, property, preferred_value, preferred_confidence, evidence_count, n_claims, status."""
    c = claims(evidence, current)
    return c.groupBy("node_id", "property").agg(
        F.max(F.when(F.col("preferred"), F.col("value"))).alias("preferred_value"),
        F.round(F.max(F.when(F.col("preferred"), F.col("confidence"))), 9).alias("preferred_confidence"),
        F.sum("evidence_count").alias("evidence_count"),
        F.count("*").alias("n_claims"),
        F.max("belief_status").alias("status"),
    )


def consolidate(current: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new current values, new evidence) after updates (node_id, property, value, source, ts, confidence),
    one a node and property. Evidence says whether the update conflicts with the stored value and keeps that value."""
    old = current.select("node_id", "property", F.col("value").alias("old"))
    met = updates.join(old, ["node_id", "property"], "left")
    conflict = F.coalesce(F.col("old") != F.col("value"), F.lit(False))
    evidence = met.select(
        "node_id", "property", "value", "source", "ts", "confidence",
        conflict.alias("conflicts_with_prior"), conflict.alias("supersedes_prior"), F.when(conflict, F.col("old")).alias("previous_value"), conflict.alias("historical_evidence_retained"),
    )
    kept = current.join(updates.select("node_id", "property"), ["node_id", "property"], "left_anti")
    return kept.unionByName(updates.select(*current.columns)), evidence


def property_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """node_id, property, old_value, new_value of keys that were added, changed or removed; internal fact keys are left out."""
    a = old.select("node_id", "property", F.col("value").alias("old_value"))
    b = new.select("node_id", "property", F.col("value").alias("new_value"))
    both = a.join(b, ["node_id", "property"], "full_outer")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")) & ~F.col("property").isin(INTERNAL_KEYS))
