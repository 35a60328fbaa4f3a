"""Listings, look-ups, validators and their paging.

Every listing filters on plain columns, so filters reach the scan, and has a
total order that ends in the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemosia.functions.text import normalize_alias

MAX_LIMIT, MAX_OFFSET, MAX_QUERY, MAX_ID = 1000, 100_000, 2000, 255


class NotFound(LookupError):
    pass


def checked(limit: int, offset: int = 0, default: int = 50, cap: int = MAX_LIMIT) -> tuple[int, int]:
    """A limit below 1 is the default, above the cap the cap; a negative or too large offset is an error."""
    if offset < 0 or offset > MAX_OFFSET:
        raise ValueError(f"offset must be from 0 to {MAX_OFFSET}")
    return (default if limit < 1 else min(limit, cap)), offset


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """The page's rows with has_more: one row beyond the page is looked at, not returned.

    order must be total."""
    limit, offset = checked(limit, offset)
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    n = rows.select(F.count("*").alias("_n"))
    return rows.orderBy(*order).limit(limit).join(F.broadcast(n)).withColumn("has_more", F.col("_n") > limit).drop("_n")


def get(df: DataFrame, **key) -> DataFrame:
    """The row with the key; NotFound if there is none."""
    found = df
    for name, value in key.items():
        found = found.where(F.col(name) == value)
    if found.isEmpty():
        raise NotFound(str(key))
    return found


def list_nodes(nodes: DataFrame, kind: str = "", min_salience: float = 0.0, limit: int = 50, offset: int = 0) -> DataFrame:
    if kind:
        nodes = nodes.where(F.col("type") == kind)
    if min_salience > 0:
        nodes = nodes.where(F.col("salience_score") >= min_salience)
    return page(nodes, [F.desc("salience_score"), F.desc("updated_at"), F.asc("id")], limit, offset)


def active_on(day) -> Column:
    """Bounds are inclusive; a null bound is open."""
    day = F.lit(day).cast("date")
    return (F.col("date_lower").isNull() | (F.col("date_lower") <= day)) & (F.col("date_upper").isNull() | (F.col("date_upper") >= day))


def filter_edges(edges: DataFrame, source: str = "", target: str = "", relation: str = "", active: str = "", current: bool | None = None) -> DataFrame:
    """A null is_current fits neither true nor false."""
    for name, value in (("source", source), ("target", target), ("relation", relation)):
        if value:
            edges = edges.where(F.col(name) == value)
    if active:
        edges = edges.where(active_on(active))
    if current is not None:
        edges = edges.where(F.col("is_current") == F.lit(current))
    return edges


def list_edges(edges: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    order = [F.desc("updated_at")] if "updated_at" in edges.columns else []
    return page(filter_edges(edges, **filters), [*order, F.asc("source"), F.asc("target"), F.asc("relation")], limit, offset)


def node_by_label(nodes: DataFrame, aliases: DataFrame, labels: DataFrame) -> DataFrame:
    """label, id, match_rank for each row of labels (label): the one node of the best tier that fits.

    Tiers: equal label without case, equal alias without case, equal normalised alias. If the best
    tier has several nodes, the label is ambiguous and has no row."""
    wanted = labels.select("label").distinct().withColumn("low", F.lower("label")).withColumn("norm", normalize_alias(F.col("label")))
    named = nodes.select("id", F.lower("label").alias("low"))
    tiers = (
        wanted.join(named, "low").select("label", "id", F.lit(1).alias("match_rank"))
        .unionByName(wanted.join(aliases.select(F.lower("alias").alias("low"), F.col("node_id").alias("id")), "low").select("label", "id", F.lit(2).alias("match_rank")))
        .unionByName(wanted.join(aliases.select(F.col("normalized_alias").alias("norm"), F.col("node_id").alias("id")), "norm").select("label", "id", F.lit(3).alias("match_rank")))
    )
    best = tiers.groupBy("label", "match_rank").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    top = best.groupBy("label").agg(F.min(F.struct("match_rank", "id", "last")).alias("b"))
    return top.where("b.id = b.last").select("label", "b.id", "b.match_rank")


def list_aliases(aliases: DataFrame, node_id: str = "", name: str = "", kind: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    if node_id:
        aliases = aliases.where(F.col("node_id") == node_id)
    if name:
        aliases = aliases.where(F.col("normalized_alias") == normalize_alias(F.lit(name)))
    if kind:
        aliases = aliases.where(F.col("alias_type") == kind)
    return page(aliases, [F.asc("normalized_alias"), F.asc("node_id"), F.asc("alias")], limit, offset)


def query_audit(audit: DataFrame, entity_type: str = "", entity_id: str = "", action: str = "", since=None, limit: int = 50, offset: int = 0) -> DataFrame:
    for name, value in (("entity_type", entity_type), ("entity_id", entity_id), ("action", action)):
        if value:
            audit = audit.where(F.col(name) == value)
    if since is not None:
        audit = audit.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return page(audit, [F.desc("created_at"), F.desc("id")], limit, offset)


def purge_audit(audit: DataFrame, as_of, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that are older than `days`)."""
    old = F.col("created_at") < F.expr(f"timestamp_ntz'{as_of}' - make_dt_interval({int(days)})")
    return audit.where(~old), audit.where(old)


def property_history(history: DataFrame, node_id: str, key: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    rows = history.where(F.col("node_id") == node_id)
    return page(rows.where(F.col("property_key") == key) if key else rows, [F.desc("changed_at"), F.desc("id")], limit, offset)


def event_links(links: DataFrame, event_id: str) -> DataFrame:
    return links.where(F.col("event_id") == event_id).orderBy("created_at", "node_id", "role")


def relation_types(own: DataFrame, tenant: str) -> DataFrame:
    """Global types and the tenant's own, by name."""
    return own.where(F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant)).orderBy("name")


def unknown_relations(rows: DataFrame, resolved: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(rows.where(F.col("resolved") == F.lit(resolved)), [F.desc("count"), F.asc("id")], limit, offset)


def maintenance_scan(nodes: DataFrame, limit: int = 100) -> DataFrame:
    """Nodes that need work, with the reasons as columns: no embedding, no search text, facts, superseded."""
    marked = nodes.withColumns(
        {
            "needs_embedding": F.col("embedding").isNull(),
            "needs_search_text": F.coalesce(F.trim("search_text"), F.lit("")) == "",
            "has_facts": F.coalesce(F.get_json_object("properties", "$._fact_evidence").isNotNull(), F.lit(False)),
            "superseded": F.col("superseded_by").isNotNull(),
        }
    )
    due = marked.where("needs_embedding OR needs_search_text OR has_facts OR superseded")
    return due.orderBy(F.desc("updated_at"), F.desc("created_at"), "id").limit(checked(limit, default=100)[0])


def list_feedback(feedback: DataFrame, outcome: str = "", limit: int = 25) -> DataFrame:
    rows = feedback.where(F.col("outcome") == outcome) if outcome else feedback
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(checked(limit, default=25, cap=100)[0])


def existing_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids (id) that are nodes."""
    return ids.select("id").distinct().join(nodes.select("id"), "id", "left_semi")


def _violations(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))


def _text_rules(*limits: tuple[str, int]) -> list[tuple[str, Column]]:
    out = []
    for name, most in limits:
        out.append((f"{name}_required", F.coalesce(F.trim(F.col(name)), F.lit("")) == ""))
        out.append((f"{name}_too_long", F.octet_length(F.col(name)) > most))
    return out


def node_violations() -> Column:
    """The broken rules of a row of nodes, as names."""
    return _violations([*_text_rules(("id", 255), ("type", 100), ("label", 10_000)), ("properties_too_large", F.octet_length("properties") > 65_536)])


def edge_violations() -> Column:
    return _violations([*_text_rules(("source", 255), ("target", 255), ("relation", 255)), ("weight_range", (F.col("weight") < 0) | (F.col("weight") > 1000))])


def alias_violations() -> Column:
    return _violations([*_text_rules(("node_id", 255), ("alias", 1000)), ("alias_type_too_long", F.octet_length("alias_type") > 100), ("confidence_range", (F.col("confidence") < 0) | (F.col("confidence") > 1))])


EVENT_KINDS = ["observation", "conversation", "message", "decision", "task", "promise", "outcome"]


def event_violations() -> Column:
    return _violations([*_text_rules(("id", 255), ("title", 10_000)), ("kind_unknown", ~F.col("kind").isin(EVENT_KINDS)), ("confidence_range", (F.col("confidence") < 0) | (F.col("confidence") > 1))])


def episode_violations() -> Column:
    """Rules of an episode (id, title, status, started_at, ended_at, properties); a missing status is open."""
    return _violations([
        *_text_rules(("id", 255), ("title", 10_000)), ("status_unknown", ~F.coalesce(F.nullif("status", F.lit("")), F.lit("open")).isin("open", "closed")),
        ("ends_before_start", F.col("ended_at") < F.col("started_at")), ("properties_too_large", F.octet_length("properties") > 65_536),
    ])


def link_violations() -> Column:
    """Rules of an event's link to a node."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return _violations([("node_id_required", blank("node_id")), ("role_required", blank("role"))])


def feedback_violations() -> Column:
    """Rules of a retrieval's feedback (query, outcome, note and the lists retrieved, selected, expected)."""
    lists = [F.coalesce(F.size(c), F.lit(0)) > 20 for c in ("retrieved", "selected", "expected")]
    return _violations([
        ("query_required", F.coalesce(F.trim("query"), F.lit("")) == ""), ("query_too_long", F.octet_length("query") > 500),
        ("outcome_unknown", ~F.coalesce(F.lower(F.trim("outcome")), F.lit("")).isin("helpful", "unhelpful", "missed")), ("note_too_long", F.octet_length("note") > 500), ("too_many_ids", lists[0] | lists[1] | lists[2]),
    ])


def supersede_violations() -> Column:
    """Rules of a request that new_id takes the place of old_id."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return _violations([("ids_required", blank("old_id") | blank("new_id")), ("ids_equal", F.col("old_id") == F.col("new_id")), ("old_id_too_long", F.octet_length("old_id") > MAX_ID), ("new_id_too_long", F.octet_length("new_id") > MAX_ID)])


def request_violations() -> Column:
    """Rules of what is asked of a search (query) and of a single row (id); a null is not asked."""
    return _violations([("query_too_long", F.octet_length("query") > MAX_QUERY), ("id_required", F.col("id") == ""), ("id_too_long", F.octet_length("id") > MAX_ID)])
