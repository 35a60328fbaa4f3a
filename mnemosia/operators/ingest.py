"""Ingest: chunks, extraction rows to a clean graph, episodes.

Extraction results are long tables: entities (doc, seq, name, type),
relationships (doc, seq, source, target, relation, confidence, date_start,
date_end), facts (doc, seq, subject, property, value). `seq` is the order in
which they were found; the first of equal rows stays.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The lists and maps (alias: name) down to NAME_SUFFIXES.
ENTITY_TYPES = ["person", "project", "company", "technology", "event", "decision", "concept", "place", "animal", "service"]
ENTITY_TYPE_ALIASES = {
    "location": "place",
    "lesson": "concept",
    "skill": "concept",
    "pattern": "concept",
    "principle": "concept",
    "idea": "concept",
    "feature": "concept",
    "goal": "concept",
    "metric": "concept",
    "process": "concept",
    "strategy": "concept",
    "media": "concept",
    "entity": "concept",
    "data": "concept",
    "dataset": "concept",
    "resource": "concept",
    "domain": "concept",
    "milestone": "event",
    "component": "technology",
    "endpoint": "technology",
    "tool": "technology",
    "software": "technology",
    "framework": "technology",
    "library": "technology",
    "language": "technology",
    "model": "technology",
    "database": "technology",
    "platform": "technology",
    "protocol": "technology",
    "api": "technology",
    "plugin": "technology",
    "extension": "technology",
    "equipment": "technology",
    "machine": "technology",
    "hardware": "technology",
    "device": "technology",
    "sensor": "technology",
    "organization": "company",
    "org": "company",
    "institution": "company",
    "creature": "animal",
    "pet": "animal",
    "wildlife": "animal",
    "agent": "service",
    "assistant": "service",
    "product": "project",
    "application": "project",
    "app": "project",
}
RELATION_ALIASES = {
    "helps_build": "works_on",
    "building": "works_on",
    "builds": "works_on",
    "built": "created",
    "creator_of": "created",
    "belongs_to": "product_of",
    "owned_by": "product_of",
    "employed_at": "works_at",
    "lives_in": "located_in",
    "resides_in": "located_in",
}
FACT_ALIASES = {
    "email_given_date": "email_assigned_date",
    "voice_chosen_date": "email_assigned_date",
    "voice": "voice_name",
    "voice_selected": "voice_selection_timing",
    "name_chosen_date": "born_on",
    "role_description": "role",
    "retired": "retired_date",
    "smoking_started": "smoking_start_age",
    "weight_lb": "current_weight",
    "location": "residence",
}
WEAK_CONCEPTS = ["trust", "honesty", "faith", "mission", "principle", "values"]
WEAK_PERSONAS = ["voice", "assistant", "avatar", "persona"]
DISCOURAGED_RELATIONS = ["partners_with", "prefers", "trusts", "learned", "inspired"]
SYMMETRIC_RELATIONS = ["sibling_of", "married_to", "friend_of", "partners_with", "competes_with"]
CANONICAL_RELATIONS = [
    "created", "founded", "works_at", "worked_at", "works_on", "leads", "owns", "part_of", "product_of", "deployed_on", "runs_on", "uses",
    "depends_on", "implements", "extends", "replaced_by", "enables", "supports", "parent_of", "child_of", "sibling_of", "married_to",
    "friend_of", "mentored", "located_in", "learned", "decided", "inspired", "prefers", "competes_with", "acquired", "funded",
    "partners_with", "affected_by", "achieved", "detected_in", "experienced",
]
EVENT_KINDS = ["observation", "conversation", "message", "decision", "task", "promise", "outcome"]
NAME_SUFFIXES = [", inc.", " inc.", ", inc", " inc", ", llc", " llc", ", ltd.", " ltd.", ", ltd", " ltd", ", corp.", " corp.", ", corporation", " corporation"]


def aliased(c: Column, aliases: dict[str, str]) -> Column:
    """Trimmed lower case, with aliases replaced by their name."""
    low = F.lower(F.trim(c))
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(names, low), low)


def label_variant(c: Column) -> Column:
    """The name without one company suffix, unless nothing is left."""
    name = F.trim(c)
    out = name
    for suffix in reversed(NAME_SUFFIXES):
        base = F.trim(name.substr(F.lit(1), F.length(name) - len(suffix)))
        out = F.when(F.lower(name).endswith(suffix) & (base != ""), base).otherwise(out)
    return out


def _chunks(text: str | None, max_tokens: int) -> list[dict]:
    """Pieces of whole lines: cut before a `## ` heading once max_tokens is reached, or at twice that; a
    piece starts with the last three lines of the one before, which its line numbers do not count."""
    if not text:
        return []
    lines = text.split("\n")
    if len(text.encode()) // 4 <= max_tokens:
        return [{"index": 0, "start_line": 1, "end_line": len(lines), "text": text}]
    out, at, before = [], 0, []
    while at < len(lines):
        end, size = at, sum(len(x.encode()) + 1 for x in before)
        while end < len(lines):
            if end > at and lines[end].startswith("## ") and (size - 1) // 4 >= max_tokens:
                break
            size += len(lines[end].encode()) + 1
            end += 1
            if (size - 1) // 4 >= 2 * max_tokens:
                break
        out.append({"index": len(out), "start_line": at + 1, "end_line": end, "text": "\n".join(before + lines[at:end])})
        before, at = lines[max(at, end - 3) : end], end
    return out


def chunk_markdown(docs: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """doc_id, index, start_line, end_line, text: the pieces of docs (doc_id, text); a token is four bytes."""

    @F.pandas_udf("array<struct<index:int,start_line:int,end_line:int,text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _chunks(t, max_tokens))

    return docs.select("doc_id", F.explode(cut(F.col("text"))).alias("c")).select("doc_id", "c.*")


def repair_json(raw: str) -> str:
    """The outermost object of a model's answer, made valid where a fence, a trailing comma or missing brackets spoil it."""

    def valid(s: str) -> bool:
        try:
            json.loads(s)
        except ValueError:
            return False
        return True

    text = re.sub(r"^```(?:json)?|```$", "", raw.strip()).strip()
    first, last = text.find("{"), text.rfind("}")
    if first < 0:
        return raw
    body = text[first : last + 1] if last > first else text[first:]
    for candidate in (body, re.sub(r",(\s*[}\]])", r"\1", body)):
        if valid(candidate):
            return candidate
    # close what is open outside of strings, on the whole rest of the text
    body = re.sub(r",(\s*[}\]])", r"\1", text[first:])
    stack, quoted, escaped = [], False, False
    for c in body:
        if quoted:
            quoted, escaped = (escaped or c != '"'), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    body = (body + '"' if quoted else body).rstrip().rstrip(",")
    return re.sub(r"([}\]])\s*(\[?\{)", r"\1,\2", body + "".join(reversed(stack)))


def repaired_json(c: Column) -> Column:
    @F.pandas_udf("string")
    def fix(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: None if r is None else repair_json(r))

    return fix(c)


def worthy_entity(name: Column, kind: Column) -> Column:
    words = F.size(F.split(F.trim(name), r"\s+"))
    low = F.lower(F.trim(name))
    return (
        F.when(low == "", False)
        .when(kind.isin("person", "project", "company", "place", "animal", "event", "decision"), True)
        .when(kind.isin("technology", "service"), (words >= 2) | ~low.isin(WEAK_PERSONAS))
        .when(kind == "concept", ~low.isin(WEAK_CONCEPTS) & (words >= 2)).otherwise(False)
    )


def first_by(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The first row by seq of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where("_n = 1").drop("_n")


def canonical_names(entities: DataFrame, known: DataFrame | None = None, mentioned: DataFrame | None = None) -> DataFrame:
    """doc, low, canonical: how names of a document are written: an entity's own name, also without its
    company suffix, and a person's full name for the first name where no entity has that. Known names
    (name) count for the documents that mention their first names: mentioned (doc, low), or the entities' own."""
    own = entities.select("doc", "seq", F.trim("name").alias("name"), "type")
    exact = own.select("doc", F.lower("name").alias("low"), "name", "seq", F.lit(0).alias("tier")).unionByName(own.select("doc", F.lower(label_variant(F.col("name"))).alias("low"), "name", "seq", F.lit(0).alias("tier")))
    full = own.where((F.col("type") == "person") & F.col("name").contains(" ")).select("doc", F.lower(F.split_part("name", F.lit(" "), F.lit(1))).alias("low"), "name", "seq", F.lit(1).alias("tier"))
    if known is not None:
        lows = own.select("doc", F.lower("name").alias("low")) if mentioned is None else mentioned
        named = known.where(F.trim("name").contains(" ")).select(F.trim("name").alias("name")).withColumn("low", F.lower(F.split_part("name", F.lit(" "), F.lit(1))))
        full = full.unionByName(lows.distinct().join(named.distinct(), "low").select("doc", "low", "name", F.lit(-1).alias("seq"), F.lit(1).alias("tier")))
    both = exact.unionByName(full)
    # of an entity's names the last one found is used, of first names the first
    order = F.struct((-F.col("tier")).alias("t"), F.when(F.col("tier") == 0, F.col("seq")).otherwise(-F.col("seq")).alias("s"), "name")
    return both.groupBy("doc", "low").agg(F.max_by("name", order).alias("canonical"))


def _renamed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    n = names.select("doc", F.col("low").alias("_low"), F.col("canonical").alias("_name"))
    return df.withColumn("_low", F.lower(F.trim(column))).join(n, ["doc", "_low"], "left").withColumn(column, F.coalesce("_name", F.trim(column))).drop("_low", "_name")


def finalize(entities: DataFrame, relationships: DataFrame, facts: DataFrame, known: DataFrame | None = None, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with aliases resolved, names canonical, weak rows and repeats dropped, edges oriented by both
    ends, and all of it made compact (see compaction). Without docs (doc, text) every entity counts as mentioned."""
    from . import compaction

    typed = entities.withColumn("type", aliased(F.col("type"), ENTITY_TYPE_ALIASES)).where(F.col("type").isin(ENTITY_TYPES))
    typed = typed.where(worthy_entity(F.col("name"), F.col("type")))
    low = lambda df, c: df.select("doc", F.lower(F.trim(c)).alias("low"))
    mentioned = low(typed, "name").union(low(relationships, "source")).union(low(relationships, "target")).union(low(facts, "subject"))
    names = canonical_names(typed, known, mentioned)
    kept = first_by(_renamed(typed, names, "name"), [F.col("doc"), F.lower(F.trim("name")), F.trim("type")])
    rels = _renamed(_renamed(relationships, names, "source"), names, "target").withColumn("relation", aliased(F.col("relation"), RELATION_ALIASES))
    kinds = kept.groupBy("doc", F.lower("name").alias("low")).agg(F.max_by("type", "seq").alias("kind"))
    for side in ("source", "target"):
        named = kinds.select("doc", F.col("low").alias("_low"), F.col("kind").alias(f"{side}_kind"))
        rels = rels.withColumn("_low", F.lower(side)).join(named, ["doc", "_low"], "left").drop("_low")
    service = lambda relation, kind: (F.col("relation") == relation) & (F.col("source_kind") == "service") & (F.col("target_kind") == kind)
    weak = F.col("relation").isin(DISCOURAGED_RELATIONS) | F.coalesce(service("works_on", "person") | service("uses", "service"), F.lit(False))
    own = _renamed(facts, names, "subject").withColumn("property", aliased(F.col("property"), FACT_ALIASES)).where("subject <> '' AND property <> ''")
    rels = compaction.oriented(rels.where(~weak).select(*relationships.columns), kept, own)
    own = first_by(own, [F.col("doc"), F.lower("subject"), F.col("property")]).select(*facts.columns)
    texts = kept.select("doc", F.lit("").alias("text")).distinct() if docs is None else docs
    return compaction.compact(texts, kept, rels, own)


def unknown_relation_rows(relationships: DataFrame) -> DataFrame:
    """relation_type, source_name, target_name of the relationships whose relation is not a canonical one."""
    return relationships.where(~F.col("relation").isin(CANONICAL_RELATIONS)).select(F.col("relation").alias("relation_type"), F.col("source").alias("source_name"), F.col("target").alias("target_name"))


def episodic_plan(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episodes by doc, events): events of decision and event entities, of explicit kinds and of `decided`
    relationships; the first of each kind and title; undated ones last. entities may have event_kind, started, ended."""
    explicit = F.when(F.lower(F.trim("event_kind")).isin(EVENT_KINDS), F.lower(F.trim("event_kind")))
    kind = F.when(F.col("type") == "decision", "decision").when(F.col("type") == "event", F.coalesce(explicit, F.lit("observation"))).otherwise(explicit)
    a = entities.select("doc", F.lit(0).alias("src"), "seq", kind.alias("kind"), F.trim("name").alias("title"), "started", "ended").where("kind IS NOT NULL")
    b = relationships.where(F.col("relation") == "decided").select("doc", F.lit(1).alias("src"), "seq", F.lit("decision").alias("kind"), F.concat(F.trim("source"), F.lit(" decided "), F.trim("target")).alias("title"), F.col("date_start").alias("started"), F.col("date_end").alias("ended"))
    w = Window.partitionBy("doc", "kind", F.lower("title")).orderBy("src", "seq")
    events = a.unionByName(b).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    placed = events.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.asc_nulls_last("started"), "src", "seq")))
    episodes = events.groupBy("doc").agg(F.min("started").alias("started_at"), F.max(F.coalesce("ended", "started")).alias("ended_at"), F.count("*").alias("event_count"))
    return episodes, placed
