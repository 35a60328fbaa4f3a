"""Duplicate nodes and merge suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosia.functions.text import normalize_alias, property_map

from .graph import kept

#: Nodes that a name may have to be met pair by pair.
FEW_NODES = 64


def _named(nodes: DataFrame, aliases: DataFrame, kind: str) -> DataFrame:
    """id, type, salience_score, names (sorted structs of name, is_label) of the active nodes with any name."""
    live = nodes.where(F.col("superseded_by").isNull())
    live = live.where(F.col("type") == kind) if kind else live
    named = live.select("id", "type", "salience_score", normalize_alias(F.col("label")).alias("name"), F.lit(True).alias("is_label"))
    known = live.select("id", "type", "salience_score").join(aliases.select(F.col("node_id").alias("id"), F.col("normalized_alias").alias("name")), "id")
    names = named.unionByName(known.withColumn("is_label", F.lit(False)).select(*named.columns)).where("name <> ''")
    names = names.groupBy("id", "type", "salience_score", "name").agg(F.bool_or("is_label").alias("is_label"))
    return names.groupBy("id", "type", "salience_score").agg(F.array_sort(F.collect_list(F.struct("name", "is_label"))).alias("names"))


def duplicate_classes(nodes: DataFrame, aliases: DataFrame, kind: str = "") -> tuple[DataFrame, DataFrame]:
    """(members: id, salience_score, class_id; pairs: left_class, right_class, shared_names, same_label, label_alias, n_pairs, salience).

    Nodes of one type with the same names are a class, named by its least id. Two nodes are duplicates if they share a
    name, which is a matter of their classes alone: pairs has the classes that share one, and a class of several nodes
    with itself (left_class = right_class); n_pairs is the number of pairs of nodes that a row stands for, salience the
    largest score among them. Every pair of classes with a shared name
    has a row, so names that very many differently named nodes share cost that many rows: `duplicate_pairs` does not."""
    named = _named(nodes, aliases, kind)
    classes = named.groupBy("type", "names").agg(F.min("id").alias("class_id"), F.count("*").alias("size"), F.max("salience_score").alias("top"))
    members = named.join(classes.select("type", "names", "class_id"), ["type", "names"]).select("id", "salience_score", "class_id")
    own = F.transform("names", lambda x: x["name"])
    alone = classes.where("size > 1").select(
        F.col("class_id").alias("left_class"), F.col("class_id").alias("right_class"), own.alias("shared_names"), F.exists("names", lambda x: x.is_label).alias("same_label"),
        F.lit(False).alias("label_alias"), (F.col("size") * (F.col("size") - 1) / 2).cast("long").alias("n_pairs"), F.col("top").alias("salience"),
    )
    rows = classes.select("type", "class_id", "size", "top", F.explode("names").alias("x")).select("type", "class_id", "size", "top", "x.name", "x.is_label")
    # names that only one class has cannot pair; they go before the join
    often = rows.groupBy("type", "name").agg(F.count("*").alias("n")).where("n > 1").select("type", "name")
    shared = rows.join(often, ["type", "name"])
    a, b = shared.alias("a"), shared.alias("b")
    met = a.join(b, (F.col("a.type") == F.col("b.type")) & (F.col("a.name") == F.col("b.name")) & (F.col("a.class_id") < F.col("b.class_id")))
    pairs = met.groupBy(F.col("a.class_id").alias("left_class"), F.col("b.class_id").alias("right_class")).agg(
        F.array_sort(F.collect_set("a.name")).alias("shared_names"), F.bool_or(F.col("a.is_label") & F.col("b.is_label")).alias("same_label"), F.bool_or(F.col("a.is_label") != F.col("b.is_label")).alias("label_alias"),
        F.max(F.col("a.size") * F.col("b.size")).alias("n_pairs"), F.max(F.greatest("a.top", "b.top")).alias("salience"),
    )
    return members, pairs.unionByName(alone)


def _shared(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(shared names, whether both have one as label, whether one's label is the other's alias) of two lists of name and is_label."""
    both = F.filter(a, lambda x: F.exists(b, lambda y: y["name"] == x["name"]))
    label = lambda same: F.exists(a, lambda x: F.exists(b, lambda y: (y["name"] == x["name"]) & ((x.is_label & y.is_label) if same else (x.is_label != y.is_label))))
    return F.array_sort(F.transform(both, lambda x: x["name"])), label(True), label(False)


def _hot_candidates(hot: DataFrame, limit: int) -> DataFrame:
    """left_id, right_id: pairs of nodes that share names of `hot` (type, id, salience_score, name, is_label) and can be among the first `limit`.

    Nodes with the same hot names are a class. Of two classes that share one, only the most salient members and those
    with the least ids can be among the first pairs; pairs of classes behind the limit-th one are left out."""
    signed = hot.groupBy("type", "id", "salience_score").agg(F.array_sort(F.collect_list(F.struct("name", "is_label"))).alias("sign"))
    classes = kept(signed.groupBy("type", "sign").agg(F.min("id").alias("class_id"), F.count("*").alias("size"), F.max("salience_score").alias("top")))
    members = kept(signed.join(classes.select("type", "sign", "class_id"), ["type", "sign"]).select("id", "salience_score", "class_id"))
    met = classes.select("type", "class_id", F.explode("sign.name").alias("name"))
    ids = met.alias("a").join(met.alias("b"), ["type", "name"]).where("a.class_id <= b.class_id").select(F.col("a.class_id").alias("left_class"), F.col("b.class_id").alias("right_class")).distinct()
    side = lambda n: classes.select(F.col("class_id").alias(f"{n}_class"), F.col("sign").alias(f"{n}_sign"), F.col("size").alias(f"{n}_size"), F.col("top").alias(f"{n}_top"))
    names, same, _ = _shared(F.col("left_sign"), F.col("right_sign"))
    pairs = ids.join(side("left"), "left_class").join(side("right"), "right_class").where("left_class <> right_class OR left_size > 1")
    pairs = kept(pairs.select("left_class", "right_class", F.struct(same.alias("a"), F.size(names).alias("b"), F.greatest("left_top", "right_top").cast("double").alias("c")).alias("key")))
    last = pairs.orderBy(F.desc("key")).limit(limit).agg(F.min("key").alias("key"))
    pairs = pairs.join(F.broadcast(last.select(F.col("key").alias("least"))), F.col("key") >= F.col("least"))
    wanted = pairs.select(F.col("left_class").alias("class_id")).union(pairs.select("right_class")).distinct()
    by = Window.partitionBy("class_id")
    own = members.join(wanted, "class_id", "left_semi").withColumn("s", F.row_number().over(by.orderBy(F.desc("salience_score"), "id"))).withColumn("i", F.row_number().over(by.orderBy("id")))
    own = own.where((F.col("s") <= limit) | (F.col("i") <= limit + 1)).select("class_id", "id")
    found = pairs.join(own.select(F.col("class_id").alias("left_class"), F.col("id").alias("l")), "left_class").join(own.select(F.col("class_id").alias("right_class"), F.col("id").alias("r")), "right_class")
    return found.where("left_class <> right_class OR l < r").select(F.least("l", "r").alias("left_id"), F.greatest("l", "r").alias("right_id"))


def duplicate_pairs(nodes: DataFrame, aliases: DataFrame, kind: str = "", limit: int = 25) -> DataFrame:
    """left_id, right_id, shared_names, same_label, label_alias: active nodes of one type that share a normalised label or alias.

    The first `limit`: same label first, then number of names, salience and ids. Nodes that share a name of at most
    FEW_NODES nodes are paired by it, so a node meets few others; names of more nodes are met by classes (see
    _hot_candidates). A pair from the classes has at least the place there that it has in the end, so the first ones
    are complete."""
    named = kept(_named(nodes, aliases, kind))
    rows = named.select("type", "id", "salience_score", F.inline("names"))
    often = kept(rows.groupBy("type", "name").agg(F.count("*").alias("n")).where("n > 1"))
    few = rows.join(often.where(F.col("n") <= FEW_NODES), ["type", "name"]).select("type", "name", "id")
    found = few.alias("a").join(few.alias("b"), ["type", "name"]).where("a.id < b.id").select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))
    found = found.unionByName(_hot_candidates(rows.join(often.where(F.col("n") > FEW_NODES).drop("n"), ["type", "name"]), limit)).distinct()
    side = lambda n: named.select(F.col("id").alias(f"{n}_id"), F.col("names").alias(f"{n}_names"), F.col("salience_score").alias(f"{n}_salience"))
    names, same, crossed = _shared(F.col("left_names"), F.col("right_names"))
    met = found.join(side("left"), "left_id").join(side("right"), "right_id")
    met = met.select("left_id", "right_id", names.alias("shared_names"), same.alias("same_label"), crossed.alias("label_alias"), F.greatest("left_salience", "right_salience").alias("salience"))
    return met.orderBy(F.desc("same_label"), F.desc(F.size("shared_names")), F.desc("salience"), F.asc("left_id"), F.asc("right_id")).limit(limit).drop("salience")


def merge_suggestions(nodes: DataFrame, pairs: DataFrame, min_score: float = 0.6, limit: int = 25) -> DataFrame:
    """canonical_id, duplicate_id, score, reasons of pairs, best first.

    0.55 for the same label, 0.2 for a label that is the other's alias, up to 0.3 for shared names
    and up to 0.3 for equal identity properties; at most 1, rounded to cents."""
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("salience_score").alias(f"{p}_salience"), property_map(F.col("properties")).alias(f"{p}_map"))
    met = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    name = lambda k: F.lower(F.trim(k))
    identity = lambda k: name(k).rlike(r"email|phone|url|domain|username|handle|_id$|^id$")
    same = F.map_filter("left_map", lambda k, v: identity(k) & (F.trim(v) != "") & (F.lower(F.trim(v)) == F.lower(F.trim(F.element_at("right_map", k)))))
    n_names, n_same = F.size("shared_names"), F.size(same)
    parts = [
        ("same_normalized_label", F.when(F.col("same_label"), 0.55)),
        ("label_alias_overlap", F.when(F.col("label_alias"), 0.2)),
        ("shared_names", F.when(n_names > 0, F.least(F.lit(0.3), 0.15 + 0.05 * (n_names - 1)))),
        ("matching_identity_properties", F.when(n_same > 0, F.least(F.lit(0.3), 0.2 + 0.05 * (n_same - 1)))),
    ]
    score = F.lit(0.0)
    for _, weight in parts:
        score = score + F.coalesce(weight, F.lit(0.0))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(w.isNotNull(), F.lit(code)) for code, w in parts])), ",")
    right_first = (F.col("right_salience") > F.col("left_salience")) | (F.col("right_salience") == F.col("left_salience")) & (F.col("right_id") < F.col("left_id"))
    scored = met.select(
        F.when(right_first, F.col("right_id")).otherwise(F.col("left_id")).alias("canonical_id"),
        F.when(right_first, F.col("left_id")).otherwise(F.col("right_id")).alias("duplicate_id"),
        F.round(F.least(score, F.lit(1.0)), 2).alias("score"), reasons.alias("reasons"),
    )
    return scored.where(F.col("score") >= min_score).orderBy(F.desc("score"), "canonical_id", "duplicate_id").limit(limit)
