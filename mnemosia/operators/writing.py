"""Writing an extraction to the graph: merged properties with their conflicts, entities to nodes.

A batch is resolved as a whole: names that the graph knows patch its nodes; the others are matched among
themselves, each with an earlier one of the batch, and every group of names makes one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept
from .ingest import CANONICAL_RELATIONS
from .postings import Postings
from .resolve import decided, resolve, scored_candidates, search_candidates

#: Properties that the ingest keeps for itself; they are not merged.
RESERVED = ["_property_history", "_ingested_from", "_ingested_at"]


def merged_versions(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current: node_id, property, value, seq; history: node_id, property, seq, old_value, new_value, changed_at, source).

    versions (node_id, property, seq, value, source, changed_at) are folded in the order of seq: the last value stays,
    and every version that differs from the one before is a conflict. A null is a value. The fold is a window over a
    node's property, so nothing holds a node's whole history at once."""
    own = versions.where(~F.col("property").isin(RESERVED))
    w = Window.partitionBy("node_id", "property").orderBy("seq")
    marked = own.withColumn("old_value", F.lag("value").over(w)).withColumn("_n", F.row_number().over(w)).withColumn("_last", F.lead("seq").over(w).isNull())
    history = marked.where((F.col("_n") > 1) & ~F.col("old_value").eqNullSafe(F.col("value")))
    history = history.select("node_id", "property", "seq", "old_value", F.col("value").alias("new_value"), "changed_at", "source")
    return marked.where("_last").select("node_id", "property", "value", "seq"), history


def with_history(nodes: DataFrame, history: DataFrame) -> DataFrame:
    """nodes (id, ...) with `property_history`: their conflicts in the order of seq and property; for an export, since it gathers a node's."""
    rows = history.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "property", "old_value", "new_value", "changed_at", "source"))).alias("property_history"))
    return nodes.join(rows, "id", "left")


def batch_groups(entities: DataFrame) -> DataFrame:
    """seq, root: for each entity (seq, name, type) the first one of its group.

    Equal names, whatever their case, are one. A name is matched with an earlier one by the rules of resolution among
    the ten that a search for it finds in the batch, and with that in turn with what it matches; chains are followed
    by doubling."""
    named = entities.select("seq", F.lower(F.trim("name")).alias("low"), F.trim("name").alias("name"), "type")
    first = kept(named.groupBy("low").agg(F.min(F.struct("seq", "name", "type")).alias("f")).select("low", "f.seq", "f.name", "f.type"))
    key = F.lpad(F.col("seq").cast("string"), 19, "0")  # ids in the order of seq: of equal hits the earliest count
    rows = first.select(key.alias("id"), "type", F.col("name").alias("label"))
    asked = first.select(key.alias("name_id"), "name", F.col("type").alias("kind"))
    none = first.sparkSession.createDataFrame([], "node_id string, alias string, normalized_alias string")
    found = search_candidates(asked, rows, none).where(F.col("id") < F.col("name_id"))
    links = decided(scored_candidates(found, asked, rows)).where("status = 'match'").select(F.col("name_id").alias("at"), F.col("id").alias("to"))
    to = kept(links)
    while True:  # each round doubles the length of the chains that are followed
        step = kept(to.alias("a").join(to.alias("b"), F.col("a.to") == F.col("b.at"), "left").select(F.col("a.at").alias("at"), F.coalesce("b.to", "a.to").alias("to")))
        if step.join(to, ["at", "to"], "left_anti").isEmpty():
            break
        to = step
    root = first.select("low", key.alias("at")).join(to, "at", "left").select("low", F.coalesce("to", "at").cast("long").alias("root"))
    return named.join(root, "low").select("seq", "root")


def write_entities(nodes: DataFrame, aliases: DataFrame, entities: DataFrame, source: str, at: str, postings: Postings | None = None) -> dict[str, DataFrame]:
    """nodes, actions (seq, name, action, node_id) and history after writing entities (seq, name, type, properties).

    nodes: id, type, label, properties (map<string,string>) and what else they have. A second run of the same entities
    over the result changes nothing: every name is then known, and equal values are no conflict."""
    own = entities.where(F.trim("name") != "").select(F.col("seq").cast("long").alias("seq"), F.trim("name").alias("name"), "type", "properties")
    # kept, since the resolution reads them several times and there are far fewer of them than entities
    names = kept(own.select("name", "type").distinct().select(F.concat_ws("\x01", "name", "type").alias("name_id"), "name", F.col("type").alias("kind")))
    known = kept(resolve(names, nodes, aliases, postings, lookup=True).where("status = 'match'").select("name_id", "node_id"))
    met = own.withColumn("name_id", F.concat_ws("\x01", "name", "type")).join(known, "name_id", "left")
    new = met.where("node_id IS NULL").select("seq", "name", "type", "properties")
    groups = batch_groups(new)
    heads = kept(groups.select("root").distinct().join(new.select(F.col("seq").alias("root"), "name", "type"), "root"))
    made = F.concat(F.lit("kg:"), F.substring(F.sha2(F.concat_ws("\x01", F.lower("name"), "type"), 256), 1, 24))
    made = kept(heads.select("root", made.alias("node_id"), F.col("name").alias("label"), "type"))
    placed = new.join(groups, "seq").join(made.select("root", "node_id"), "root").select("seq", "name", "properties", "node_id", F.when(F.col("seq") == F.col("root"), "created").otherwise("updated").alias("action"))
    written = kept(met.where("node_id IS NOT NULL").select("seq", "name", "properties", "node_id", F.lit("updated").alias("action")).unionByName(placed))
    touched = nodes.join(written.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi")
    version = lambda df, id_, seq, src, when: df.select(F.col(id_).alias("node_id"), seq.alias("seq"), F.lit(src).alias("source"), F.lit(when).alias("changed_at"), F.explode("properties").alias("property", "value"))
    versions = version(touched, "id", F.lit(-1).cast("long"), None, None).unionByName(version(written, "node_id", F.col("seq"), source, at))
    current, history = merged_versions(versions)
    props = current.groupBy(F.col("node_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("_new"))
    fresh = made.select(F.col("node_id").alias("id"), "type", "label", F.create_map(F.lit("_ingested_from"), F.lit(source), F.lit("_ingested_at"), F.lit(at)).alias("properties"))
    both = nodes.unionByName(fresh, allowMissingColumns=True).join(props, "id", "left")
    reserved = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(RESERVED))
    out = both.withColumn("properties", F.when(F.col("_new").isNotNull(), F.map_concat(reserved, F.col("_new"))).otherwise(F.col("properties")))
    return {"nodes": out.select(*nodes.columns), "actions": written.select("seq", "name", "action", "node_id"), "history": history}


def named_ends(names: DataFrame, known: DataFrame, nodes: DataFrame, aliases: DataFrame, postings: Postings | None = None) -> DataFrame:
    """low, node_id of names (name): what this batch wrote under the name (known: low, node_id), else the one node that resolution is sure of."""
    asked = names.where(F.trim("name") != "").select(F.lower(F.trim("name")).alias("low"), F.trim("name").alias("name")).groupBy("low").agg(F.min("name").alias("name"))
    rest = kept(asked.join(known, "low", "left_anti").select(F.col("low").alias("name_id"), "name", F.lit("").alias("kind")))
    found = resolve(rest, nodes, aliases, postings, lookup=True).where("status = 'match'").select(F.col("name_id").alias("low"), "node_id")
    return asked.select("low").join(known, "low").unionByName(found)


def write_relationships(edges: DataFrame, relationships: DataFrame, ends: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(edges, outcomes: seq, source, target, relation, outcome) after writing relationships (seq, source, target, relation, confidence, date_start, date_end, is_current).

    Ends are looked up in `ends`. A row without both is `no_end`, one whose relation is not canonical `unknown_relation`;
    of the others the first of a new edge is `created`, further ones and those of known edges are `updated`. Of an
    edge's dates the last that are given stay, of its confidence and origin the last."""
    id_of = lambda side: ends.select(F.col("low").alias(f"_{side}"), F.col("node_id").alias(f"{side}_id"))
    rows = relationships.withColumn("_source", F.lower(F.trim("source"))).withColumn("_target", F.lower(F.trim("target")))
    met = rows.join(id_of("source"), "_source", "left").join(id_of("target"), "_target", "left").drop("_source", "_target")
    key = ["source", "target", "relation"]
    first = F.row_number().over(Window.partitionBy("source_id", "target_id", "relation").orderBy("seq")) == 1
    old = edges.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "relation", F.lit(True).alias("_known"))
    told = F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "no_end").when(~F.col("relation").isin(CANONICAL_RELATIONS), "unknown_relation").when(first & F.col("_known").isNull(), "created").otherwise("updated")
    outcomes = kept(met.join(old, ["source_id", "target_id", "relation"], "left").withColumn("outcome", told).drop("_known"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    own = outcomes.where(F.col("outcome").isin("created", "updated")).groupBy(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation").agg(*[last(c) for c in ("confidence", "date_start", "date_end", "is_current")])
    new = own.select(*key, *[F.col(c).alias(f"_{c}") for c in ("confidence", "date_start", "date_end", "is_current")], F.lit(source).alias("_ingested_from"))
    both = edges.join(new, key, "full_outer")
    out = [F.coalesce(f"_{c}", c if c in edges.columns else F.lit(None)).alias(c) for c in ("confidence", "date_start", "date_end", "is_current", "ingested_from")]
    rest = [F.col(f"`{c}`") for c in edges.columns if c not in (*key, "confidence", "date_start", "date_end", "is_current", "ingested_from")]
    return both.select(*key, *out, *rest), outcomes.select("seq", "source", "target", "relation", "outcome")


def write_facts(facts: DataFrame, ends: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(updates: node_id, property, value, source, confidence, ts, seq, for `facts.consolidate`; facts whose subject is no node)."""
    met = facts.withColumn("low", F.lower(F.trim("subject"))).join(ends, "low", "left").drop("low")
    extra = lambda c, kind: (F.col(c) if c in facts.columns else F.lit(None)).cast(kind).alias(c)
    updates = met.where("node_id IS NOT NULL").select("node_id", "property", "value", F.lit(source).alias("source"), extra("confidence", "double"), extra("ts", "string"), "seq")
    return updates, met.where("node_id IS NULL").select(*facts.columns)


def write_extraction(nodes: DataFrame, aliases: DataFrame, edges: DataFrame, entities: DataFrame, relationships: DataFrame, facts: DataFrame, source: str, at: str, dry_run: bool = False) -> dict[str, DataFrame]:
    """nodes, edges, fact_updates, history, actions, outcomes and `report` (one row) after writing one extraction.

    report: entities, relationships, facts, created_nodes, updated_nodes, written_edges, skipped_edges, unknown_relations,
    skipped_facts. A dry run writes nothing and reports every entity and relationship as one that would be made."""
    counted = lambda df, **c: df.agg(*[v.alias(k) for k, v in c.items()])
    n = F.count("*")
    sizes = counted(entities, entities=n).join(F.broadcast(counted(relationships, relationships=n))).join(F.broadcast(counted(facts, facts=n)))
    if dry_run:
        zero = F.lit(0).cast("long")
        report = sizes.select("*", F.col("entities").alias("created_nodes"), zero.alias("updated_nodes"), F.col("relationships").alias("written_edges"), zero.alias("skipped_edges"), zero.alias("unknown_relations"), zero.alias("skipped_facts"))
        return {"nodes": nodes, "edges": edges, "report": report}
    done = write_entities(nodes, aliases, entities, source, at)
    after = kept(done["nodes"])
    known = kept(done["actions"].groupBy(F.lower("name").alias("low")).agg(F.max_by("node_id", "seq").alias("node_id")))
    names = relationships.select(F.col("source").alias("name")).union(relationships.select("target")).union(facts.select("subject"))
    ends = kept(named_ends(names, known, after, aliases))
    new_edges, outcomes = write_relationships(edges, relationships, ends, source)
    updates, lost = write_facts(facts, ends, source)
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    report = (
        sizes.join(F.broadcast(counted(done["actions"], created_nodes=is_("action", "created"), updated_nodes=is_("action", "updated"))))
        .join(F.broadcast(counted(outcomes, written_edges=F.count_if(F.col("outcome").isin("created", "updated")), skipped_edges=F.count_if(F.col("outcome").isin("no_end", "unknown_relation")), unknown_relations=is_("outcome", "unknown_relation"))))
        .join(F.broadcast(counted(lost, skipped_facts=n)))
    )
    return done | {"nodes": after, "edges": new_edges, "outcomes": outcomes, "fact_updates": updates, "report": report}
