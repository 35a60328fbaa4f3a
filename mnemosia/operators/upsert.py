"""Bulk upserts, imports and their validation, as joins that return the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosia.functions.text import decrypted, normalize_alias, search_text

from .facts import property_diff
from .listing import get


def last_by_key(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key, without the order column."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", order)


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str], columns: list[str], overwrite: bool = True) -> tuple[DataFrame, DataFrame]:
    """(the new table, actions (keys, action)).

    rows has the keys and columns, one row a key. With overwrite the columns of a known key are
    replaced (created_at and others stay), else the known row stays. action: created, updated or skipped."""
    new = rows.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    old = existing.withColumn("_old", F.lit(True))
    both = old.join(new, keys, "full_outer")
    known, given = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    pick = lambda c: F.when(given & (F.lit(overwrite) | ~known), F.col(f"_{c}")).otherwise(F.col(c)) if c in columns else F.col(c)
    table = both.select(*[pick(c).alias(c) for c in existing.columns])
    action = F.when(~known, "created").when(F.lit(overwrite), "updated").otherwise("skipped")
    return table, both.where(given).select(*keys, action.alias("action"))


def missing_endpoints(edges: DataFrame, *nodes: DataFrame) -> DataFrame:
    """id of every edge end that none of the node tables has."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    for n in nodes:
        ends = ends.join(n.select("id"), "id", "left_anti")
    return ends


def upsert_edges(nodes: DataFrame, existing: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """upsert() of edges; a missing end rejects the whole batch. weight is 1.0 where none is given."""
    if not missing_endpoints(rows, nodes).isEmpty():
        raise LookupError("an edge has an unknown end")
    rows = rows.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return upsert(existing, rows, ["source", "target", "relation"], [c for c in rows.columns if c not in ("source", "target", "relation")])


def validate_import(version: int, supported: int, new_nodes: DataFrame, new_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """problem, subject: a newer schema version, nodes without id, edges with unknown ends."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([("schema_version_too_new", str(version))] if version > supported else [], "problem string, subject string")
    empty = new_nodes.where(F.coalesce(F.trim("id"), F.lit("")) == "").select(F.lit("empty_node_id").alias("problem"), F.col("label").alias("subject"))
    ends = missing_endpoints(new_edges, new_nodes, nodes).select(F.lit("unknown_endpoint").alias("problem"), F.col("id").alias("subject"))
    return head.unionByName(empty).unionByName(ends)


def export_header(nodes: DataFrame, edges: DataFrame, schema_version: int, tenant: str) -> DataFrame:
    """One row: schema_version, tenant, n_nodes, n_edges."""
    left = nodes.agg(F.count("*").alias("n_nodes")).join(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))
    return left.select(F.lit(schema_version).alias("schema_version"), F.lit(tenant).alias("tenant"), "n_nodes", "n_edges")


def export_document(nodes: DataFrame, edges: DataFrame, schema_version: int, version: str, tenant: str, exported_at: str, key: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, nodes, edges): the header has the program's version and the time too; with a key, properties are decrypted.

    A property text that does not open under the key is an error of that row: its properties are null and `unreadable` is true."""
    head = export_header(nodes, edges, schema_version, tenant).withColumns({"version": F.lit(version), "exported_at": F.lit(exported_at).cast("timestamp_ntz")})
    if key is not None:
        plain = decrypted(F.col("properties"), F.lit(key))
        nodes = nodes.withColumn("_plain", plain).withColumn("unreadable", F.col("properties").isNotNull() & F.col("_plain").isNull()).withColumn("properties", F.col("_plain")).drop("_plain")
    return head, *export_rows(nodes, edges)


def export_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by creation and id, edges by key."""
    return nodes.orderBy("created_at", "id"), edges.orderBy("source", "target", "relation")


def update_embeddings(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """nodes with the embeddings (id, embedding) that are given."""
    new = vectors.select("id", F.col("embedding").alias("_e"))
    return nodes.join(new, "id", "left").withColumn("embedding", F.coalesce("_e", "embedding")).drop("_e").select(*nodes.columns)


def without_embedding(nodes: DataFrame, limit: int = 100) -> DataFrame:
    return nodes.where(F.col("embedding").isNull()).orderBy("created_at", "id").limit(limit)


def set_dimension(nodes: DataFrame, dim: int) -> DataFrame:
    """Embeddings of another length become null."""
    return nodes.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")))


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """existing with rows; a key that is known or given twice is an error."""
    twice = rows.groupBy(*keys).count().where("count > 1")
    if not twice.isEmpty() or not rows.join(existing.select(*keys), keys, "left_semi").isEmpty():
        raise ValueError("duplicate key")
    return existing.unionByName(rows.select(*existing.columns))


def upsert_nodes(existing: DataFrame, rows: DataFrame, changed_at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the new table, actions, history) of nodes (id, type, label, properties as a map of JSON texts).

    rows has seq too: of rows with one id the last counts. history has node_id, property_key, old_value, new_value,
    changed_at for every property of a known node that was added, changed or removed."""
    given = last_by_key(rows, ["id"])
    table, actions = upsert(existing, given, ["id"], ["type", "label", "properties"])
    known = given.join(existing.select("id"), "id", "left_semi")
    long = lambda df: df.select(F.col("id").alias("node_id"), F.explode("properties").alias("property", "value"))
    diff = property_diff(long(existing.join(known.select("id"), "id", "left_semi")), long(known))
    history = diff.select("node_id", F.col("property").alias("property_key"), "old_value", "new_value", F.lit(changed_at).cast("timestamp_ntz").alias("changed_at"))
    return table, actions, history


def import_graph(version: int, supported: int, new_nodes: DataFrame, new_edges: DataFrame, nodes: DataFrame, edges: DataFrame, overwrite: bool = False, dry_run: bool = False, reset_usage: bool = False, regenerate_embeddings: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts (what, action, n)) after an import; nodes go before edges.

    Problems found by validate_import are an error. A dry run counts and changes nothing; with reset_usage the
    imported nodes start with no accesses and no boost, with regenerate_embeddings without a vector, so that
    `without_embedding` lists them."""
    problems = validate_import(version, supported, new_nodes, new_edges, nodes)
    if not problems.isEmpty():
        raise ValueError(str(problems.limit(5).collect()))
    if reset_usage:
        new_nodes = new_nodes.withColumns({c: v for c, v in {"access_count": F.lit(0).cast("long"), "last_accessed": F.lit(None).cast("timestamp_ntz"), "user_boosted": F.lit(False)}.items() if c in new_nodes.columns})
    if regenerate_embeddings and "embedding" in new_nodes.columns:
        new_nodes = new_nodes.withColumn("embedding", F.lit(None).cast(new_nodes.schema["embedding"].dataType))
    own = lambda df, keys: [c for c in df.columns if c not in keys]
    ends = ["source", "target", "relation"]
    all_nodes, a = upsert(nodes, new_nodes, ["id"], own(new_nodes, ["id"]), overwrite)
    all_edges, b = upsert(edges, new_edges, ends, own(new_edges, ends), overwrite)
    counts = a.groupBy("action").count().select(F.lit("nodes").alias("what"), "action", F.col("count").alias("n")).unionByName(b.groupBy("action").count().select(F.lit("edges").alias("what"), "action", F.col("count").alias("n")))
    return (nodes, edges, counts) if dry_run else (all_nodes, all_edges, counts)


def _is(**key) -> Column:
    out = F.lit(True)
    for name, value in key.items():
        out = out & (F.col(name) == value)
    return out


def update_rows(table: DataFrame, key: dict[str, str], values: dict) -> DataFrame:
    """The table with the columns of the row with the key replaced; NotFound if there is none."""
    get(table, **key)
    return table.select(*[F.when(_is(**key), F.lit(values[c])).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in values else F.col(c) for c in table.columns])


def delete_rows(table: DataFrame, **key) -> DataFrame:
    """The table without the row with the key; NotFound if there is none."""
    get(table, **key)
    return table.where(~F.coalesce(_is(**key), F.lit(False)))


def create_edge(nodes: DataFrame, edges: DataFrame, row: DataFrame) -> DataFrame:
    """edges with a new row; an unknown end or a known key is an error; weight is 1.0 where none is given."""
    if not missing_endpoints(row, nodes).isEmpty():
        raise LookupError("an edge has an unknown end")
    return insert_new(edges, row.withColumn("weight", F.coalesce("weight", F.lit(1.0))), ["source", "target", "relation"])


def create_alias(nodes: DataFrame, aliases: DataFrame, row: DataFrame) -> DataFrame:
    """aliases with a new row, normalised; its node must exist and must not have that alias."""
    row = row.withColumn("normalized_alias", normalize_alias(F.col("alias")))
    if not row.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").isEmpty():
        raise LookupError("an alias has an unknown node")
    return insert_new(aliases, row, ["node_id", "normalized_alias"])


def add_relation_type(types: DataFrame, name: str, tenant: str) -> DataFrame:
    """Relation types (name, tenant_id) with one of the tenant's own; a name it already sees is an error."""
    spark = types.sparkSession
    if not types.where((F.col("name") == name) & (F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant))).isEmpty():
        raise ValueError("duplicate key")
    return types.unionByName(spark.createDataFrame([(name, tenant)], "name string, tenant_id string"))


def resolve_unknown(rows: DataFrame, relation: str, canonical: str) -> DataFrame:
    """Unknown relations of a type marked as resolved to a canonical one; NotFound if there are none."""
    get(rows, relation_type=relation)
    hit = F.col("relation_type") == relation
    return rows.withColumn("resolved", F.col("resolved") | hit).withColumn("resolved_as", F.when(hit, F.lit(canonical)).otherwise(F.col("resolved_as")))


def maintenance_run(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with search_text written anew where it is missing, one row of counters)."""
    marked = nodes.withColumn("_text", F.coalesce(F.trim("search_text"), F.lit("")) == "")
    counters = marked.agg(
        F.count("*").alias("scanned"), F.count_if("_text").alias("texts_written"), F.count_if(F.col("embedding").isNull()).alias("embeddings_missing"),
        F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.count_if(F.get_json_object("properties", "$._fact_evidence").isNotNull()).alias("with_facts"),
    )
    written = marked.withColumn("search_text", F.when(F.col("_text"), search_text(F.col("label"), F.col("type"), F.col("properties"))).otherwise(F.col("search_text")))
    return written.select(*nodes.columns), counters


def known_entities(nodes: DataFrame, limit: int = 50, least: float = 1.0) -> DataFrame:
    """name: the labels of the most salient nodes, each once."""
    top = nodes.where(F.col("salience_score") >= least).orderBy(F.desc("salience_score"), F.desc("updated_at"), "id").limit(limit)
    return top.select(F.col("label").alias("name")).distinct()
