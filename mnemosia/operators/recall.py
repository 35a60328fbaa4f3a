"""Recall packs: event contexts, neighbours, episodes, decisions, contradictions, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_STATUSES = ["open", "pending", "active", "unresolved", "todo", "in_progress"]
OPEN_KINDS = ["decision", "task", "promise"]
LIMITS = {"neighbors": 4, "episodes": 4, "decisions": 3, "contradictions": 3, "evidence": 4}
CAP = 10


def limit_of(section: str, limit: int = 0) -> int:
    return min(limit, CAP) if limit > 0 else LIMITS[section]


def occurred_at() -> Column:
    return F.coalesce("occurred_at", "occurred_end_at", "occurred_start_at", "created_at")


def event_contexts(events: DataFrame, links: DataFrame, episodes: DataFrame, ids: DataFrame, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Events linked to any of the ids (id), with their episode, and the linked ids and roles among the ids.

    By time (latest first), confidence and id."""
    rows = events.where(F.col("kind").isin(kinds)) if kinds else events
    own = links.join(ids.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
    tied = own.groupBy("event_id").agg(F.array_sort(F.collect_set("node_id")).alias("linked_ids"), F.array_sort(F.collect_set("role")).alias("roles"))
    titles = episodes.select(F.col("id").alias("episode_id"), F.col("title").alias("episode_title"), F.col("status").alias("episode_status"))
    met = rows.join(tied, rows.id == tied.event_id).drop("event_id").join(titles, "episode_id", "left").withColumn("at", occurred_at())
    return met if limit is None else met.orderBy(F.desc("at"), F.desc("confidence"), "id").limit(limit)


def recall_neighbors(edges: DataFrame, nodes: DataFrame, ids: DataFrame, limit: int = 0) -> DataFrame:
    """id, relation, direction, weight, salience, score, roots: neighbours of the ids outside them, by 2 salience + 3 edge salience + weight."""
    core = ids.select("id").distinct()
    edge_salience = F.col("salience_score") if "salience_score" in edges.columns else F.lit(1.0)
    e = edges.select("source", "target", "relation", "weight", edge_salience.alias("edge_salience"))
    out = e.join(core.withColumnRenamed("id", "source"), "source").select(F.col("source").alias("root"), F.col("target").alias("id"), "relation", F.lit("out").alias("direction"), "weight", "edge_salience")
    back = e.join(core.withColumnRenamed("id", "target"), "target").select(F.col("target").alias("root"), F.col("source").alias("id"), "relation", F.lit("in").alias("direction"), "weight", "edge_salience")
    near = out.unionByName(back).join(core, "id", "left_anti").join(nodes.select("id", "salience_score"), "id")
    grouped = near.groupBy("id", "relation", "direction").agg(
        F.max("weight").alias("weight"), F.max("edge_salience").alias("salience"),
        F.round(F.max(2 * F.col("salience_score") + 3 * F.col("edge_salience") + F.col("weight")), 6).alias("score"),
        F.array_sort(F.collect_set("root")).alias("roots"),
    )
    return grouped.orderBy(F.desc("score"), "id", "relation", "direction").limit(limit_of("neighbors", limit))


def decision_status(properties: Column) -> Column:
    """The first of status, state and decision_status that is an open one."""
    named = [F.lower(F.trim(F.get_json_object(properties, f"$.{k}"))) for k in ("status", "state", "decision_status")]
    return F.coalesce(*[F.when(v.isin(OPEN_STATUSES), v) for v in named])


def open_decisions(contexts: DataFrame, limit: int = 0) -> DataFrame:
    """Decisions, tasks and promises that are open, or whose episode is."""
    status = F.coalesce(decision_status(F.col("properties")), F.when(F.col("episode_status") == "open", F.lit("open")))
    rows = contexts.where(F.col("kind").isin(OPEN_KINDS)).withColumn("open_status", status).where("open_status IS NOT NULL")
    return rows.select("id", "kind", "title", "open_status", "at").orderBy(F.desc("at"), "id").limit(limit_of("decisions", limit))


def recent_episodes(contexts: DataFrame, limit: int = 0) -> DataFrame:
    """key, n_events, kinds, linked_ids, n_open, latest_event, latest_outcome, at: contexts by episode, or by event where there is none."""
    key = F.coalesce("episode_id", F.concat(F.lit("event:"), F.col("id")))
    is_open = F.col("kind").isin(OPEN_KINDS) & F.coalesce(decision_status(F.col("properties")).isNotNull(), F.lit(False))
    order = F.struct("at", "id")
    grouped = contexts.withColumn("key", key).groupBy("key").agg(
        F.count("*").alias("n_events"), F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("linked_ids")))).alias("linked_ids"),
        F.count_if(is_open).alias("n_open"), F.max_by("id", order).alias("latest_event"),
        F.max_by(F.when(F.col("kind") == "outcome", F.col("id")), F.when(F.col("kind") == "outcome", order)).alias("latest_outcome"), F.max("at").alias("at"),
    )
    return grouped.orderBy(F.desc("at"), "key").limit(limit_of("episodes", limit))


def contradictions(claims: DataFrame, ids: DataFrame, limit: int = 0) -> DataFrame:
    """node_id, property, status, preferred_value, other_value: contested beliefs first, then superseded ones. claims is facts.claims()."""
    own = claims.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    grouped = own.where(F.col("belief_status") != "supported").groupBy("node_id", "property").agg(
        F.max("belief_status").alias("status"), F.max(F.when(F.col("preferred"), F.col("value"))).alias("preferred_value"),
        F.min_by("value", F.when(~F.col("preferred"), F.col("place"))).alias("other_value"),
    )
    return grouped.orderBy((F.col("status") != "contested").cast("int"), "node_id", "property").limit(limit_of("contradictions", limit))


def strongest_evidence(evidence: DataFrame, nodes: DataFrame, ids: DataFrame, limit: int = 0) -> DataFrame:
    """node_id, property, value, source, ts, score: by confidence (none is 0) plus salience of 100."""
    own = evidence.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").join(nodes.select(F.col("id").alias("node_id"), "salience_score"), "node_id")
    scored = own.withColumn("score", F.round(F.coalesce("confidence", F.lit(0.0)) + F.col("salience_score") / 100.0, 9))
    return scored.select("node_id", "property", "value", "source", "ts", "score").orderBy(F.desc("score"), F.desc("ts"), "node_id", "property", "value").limit(limit_of("evidence", limit))


def recall_pack(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Six frames: core, neighbors, episodes, decisions, contradictions, evidence.

    tables: nodes, edges, events, links, episodes, claims, evidence."""
    nodes = tables["nodes"]
    core = nodes.join(ids.select("id").distinct(), "id", "left_semi").orderBy(F.desc("salience_score"), F.desc("updated_at"), "id")
    contexts = event_contexts(tables["events"], tables["links"], tables["episodes"], ids)
    return {
        "core": core,
        "neighbors": recall_neighbors(tables["edges"], nodes, ids),
        "episodes": recent_episodes(contexts),
        "decisions": open_decisions(contexts),
        "contradictions": contradictions(tables["claims"], ids),
        "evidence": strongest_evidence(tables["evidence"], nodes, ids),
    }


def nth_by(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
