"""A document's extraction made compact: who counts, how edges point, what is left.

Tables are those of `ingest`: entities (doc, seq, name, type; description and properties, a map, if
there are any), relationships (doc, seq, source, target, relation; is_current, date_end if any), facts
(doc, seq, subject, property, value), and docs (doc, text). Names meet by their trimmed lower case.
Everything is an aggregate, a ranked window or a semi-join by document and name; a text is read once,
beside the list of its document's own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept
from .ingest import CANONICAL_RELATIONS, RELATION_ALIASES, SYMMETRIC_RELATIONS, aliased, first_by, label_variant

#: Points of a type, of an end of a relationship, of a fact; least points; most entities of a profile.
TYPE_POINTS = {"person": 6, "project": 5, "company": 5, "place": 4, "decision": 4, "event": 4, "concept": 4, "service": 3, "technology": 2, "animal": 1}
EDGE_POINTS, FACT_POINTS, LEAST_GENERAL, LEAST_PROFILE, PROFILE_MOST = 3, 2, 2, 5, 12
#: Phrases of a description that cost points, files that describe a person, the one who always stays there.
COSTLY = {"potential acquisition target": 3, "voice model": 2}
PROFILE_FILES, PROFILE_BULLETS, SAMPLE_BYTES, ALWAYS_KEPT = ["# user.md", "# soul.md", "# identity.md"], 6, 2000, "scout"
BIRTHDAYS = ["birthday", "birth_date"]
_BLANKS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def low(c: Column | str) -> Column:
    return F.lower(F.trim(c))


def document_kind(text: Column) -> Column:
    """'profile' if the first 2000 bytes name a profile's file or have six bold bullets, else 'general'."""
    # bytes as Latin letters, so that a cut within a letter does no harm
    sample = F.decode(F.substring(F.encode(F.lower(F.coalesce(text, F.lit(""))), "UTF-8"), 1, SAMPLE_BYTES), "ISO-8859-1")
    named = F.lit(False)
    for f in PROFILE_FILES:
        named = named | sample.contains(f)
    return F.when(named | (F.regexp_count(sample, F.lit(r"- \*\*")) >= PROFILE_BULLETS), "profile").otherwise("general")


def mention_text(c: Column) -> Column:
    """Lower case, with punctuation and runs of white space as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ",.()[]{}:;\n\t-", " " * 13), _BLANKS, " "))


def mention_forms(name: Column, kind: Column) -> Column:
    """What a text may call an entity: its name, the name without a company's ending, a person's first name."""
    parts = F.split(F.trim(F.regexp_replace(name, _BLANKS, " ")), " ")
    first = F.when((kind == "person") & (F.size(parts) >= 2), F.element_at(parts, 1))
    return F.array_compact(F.array(mention_text(name), mention_text(label_variant(name)), mention_text(first)))


def _optional(df: DataFrame, column: str, otherwise: Column) -> Column:
    return F.coalesce(F.col(column), otherwise) if column in df.columns else otherwise


def entity_support(entities: DataFrame, relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """doc, low, score, n_relations, n_facts, n_properties of every name that an entity has."""
    points = F.lit(0)
    for kind, n in TYPE_POINTS.items():
        points = F.when(F.col("type") == kind, n).otherwise(points)
    said = F.lower(_optional(entities, "description", F.lit("")))
    held = F.size(_optional(entities, "properties", F.create_map().cast("map<string,string>")))
    cost = F.lit(0)
    for phrase, n in COSTLY.items():
        cost = cost + F.when(said.contains(phrase), n).otherwise(0)
    zero = F.lit(0)
    part = lambda df, name, score, r, f, p, own: df.select("doc", low(name).alias("low"), score.cast("long").alias("score"), r.alias("r"), f.alias("f"), p.alias("p"), F.lit(own).alias("own"))
    rows = part(entities, "name", points + held + F.when(F.trim(said) != "", 1).otherwise(0) - cost, zero, zero, held, True)
    for side in ("source", "target"):
        rows = rows.unionByName(part(relationships, side, F.lit(EDGE_POINTS), F.lit(1), zero, zero, False))
    rows = rows.unionByName(part(facts, "subject", F.lit(FACT_POINTS), zero, F.lit(1), zero, False))
    sums = rows.groupBy("doc", "low").agg(F.sum("score").alias("score"), F.sum("r").alias("n_relations"), F.sum("f").alias("n_facts"), F.sum("p").alias("n_properties"), F.bool_or("own").alias("own"))
    return sums.where("own").drop("own")


def mentioned(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """entities with `profile` (whether the document is one), restricted to those that their text mentions; an empty or missing text mentions all."""
    forms = entities.groupBy("doc").agg(F.collect_set(F.struct(F.col("name"), F.col("type"), mention_forms(F.col("name"), F.col("type")).alias("forms"))).alias("own"))
    text = F.coalesce("text", F.lit(""))
    # made before the join, so once a text and not once a form
    plain = docs.select("doc", (document_kind(text) == "profile").alias("profile"), (F.regexp_replace(text, _BLANKS, "") == "").alias("blank"), mention_text(text).alias("plain"))
    met = forms.join(plain, "doc", "left").select(
        "doc", F.coalesce("profile", F.lit(False)).alias("profile"),
        F.when(F.coalesce("blank", F.lit(True)), F.col("own")).otherwise(F.filter("own", lambda e: F.exists(e["forms"], lambda x: F.col("plain").contains(x)))).alias("own"),
    )
    seen = met.select("doc", "profile", F.inline("own")).select("doc", "profile", "name", "type")
    return entities.join(seen, ["doc", "name", "type"])


def compact_entities(docs: DataFrame, entities: DataFrame, relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """The entities that stay, one of each name: mentioned, with enough support for their document's kind, and of a profile the 12 best."""
    support = entity_support(entities, relationships, facts)
    seen = mentioned(entities.where(F.trim("name") != ""), docs).withColumn("_low", low("name"))
    met = seen.join(support.withColumnRenamed("low", "_low"), ["doc", "_low"])
    said = F.lower(_optional(entities, "description", F.lit("")))
    target, voice = said.contains("potential acquisition target"), said.contains("voice model")
    r, f, p, kind = F.col("n_relations"), F.col("n_facts"), F.col("n_properties"), F.col("type")
    of_profile = (
        F.when(kind == "person", (r > 0) | (f > 0) | (p > 0))
        .when(kind.isin("project", "company", "place", "decision", "event", "concept"), ~(target & (f == 0)) & (F.col("score") >= LEAST_PROFILE))
        .when(kind == "service", (F.col("_low") == ALWAYS_KEPT) | (r >= 2) | (f >= 3) & ~voice)
        .when(kind == "technology", (r >= 2) | (f >= 3))
        .when(kind == "animal", (F.size(F.split(F.trim(F.regexp_replace("name", _BLANKS, " ")), " ")) >= 2) & ((r >= 2) | (f >= 2)))
        .otherwise(False)
    )
    stay = met.where(F.when(F.col("profile"), of_profile).otherwise(F.col("score") >= LEAST_GENERAL))
    points = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_POINTS.items() for x in kv]), kind), F.lit(0))
    once = stay.withColumn("_n", F.row_number().over(Window.partitionBy("doc", "_low").orderBy(points.desc(), "seq"))).where("_n = 1")
    best = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "_low"))
    return once.withColumn("_n", best).where(~F.col("profile") | (F.col("_n") <= PROFILE_MOST)).select(*entities.columns)


def edge_key() -> list[Column]:
    """document, ends and relation; the ends of a symmetric relation in their order."""
    a, b = low("source"), low("target")
    turned = F.col("relation").isin(SYMMETRIC_RELATIONS) & (a > b)
    return [F.col("doc"), F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b), F.col("relation")]


def ends(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """doc, low, kind, birthday: of each name the type of its last entity, and the last birthday in facts, else in properties."""
    kinds = entities.select("doc", low("name").alias("low"), F.struct("seq", "type").alias("k"), F.lit(None).cast("struct<src:int,seq:bigint,n:int,v:string>").alias("b"))
    born = lambda src, n, value: F.struct(F.lit(src).alias("src"), F.col("seq").cast("long").alias("seq"), F.lit(n).alias("n"), value.alias("v"))
    rows = kinds
    none = F.lit(None).cast(kinds.schema["k"].dataType)
    if "properties" in entities.columns:
        for n, key in enumerate(BIRTHDAYS):
            value = F.element_at("properties", key)
            rows = rows.unionByName(entities.where(F.trim(value) != "").select("doc", low("name").alias("low"), none.alias("k"), born(0, n, value).alias("b")))
    said = facts.where(F.col("property").isin(BIRTHDAYS)).select("doc", low("subject").alias("low"), none.alias("k"), born(1, 0, F.trim(F.col("value").cast("string"))).alias("b"))
    return rows.unionByName(said).groupBy("doc", "low").agg(F.max("k")["type"].alias("kind"), F.max("b")["v"].alias("birthday"))


def oriented(relationships: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """relationships with canonical relations that fit both ends, the first of each ends and relation.

    What a person founded or has as `product_of` a project they created; a project that created a person is
    turned round; work that ended is `worked_at`; the elder of two with birthdays is the parent. Relations that
    are not canonical, and edges of one name with itself, go."""
    rows = relationships.withColumn("relation", aliased(F.col("relation"), RELATION_ALIASES)).where((F.trim("source") != "") & (F.trim("target") != "") & (F.lower("source") != F.lower("target")))
    known = ends(entities, facts)
    for side in ("source", "target"):
        own = known.select("doc", F.col("low").alias("_low"), F.col("kind").alias(f"_{side}_kind"), F.col("birthday").alias(f"_{side}_born"))
        rows = rows.withColumn("_low", low(side)).join(own, ["doc", "_low"], "left").drop("_low")
    is_, kinds = F.col("relation"), lambda a, b: (F.col("_source_kind") == a) & (F.col("_target_kind") == b)
    ended = (_optional(relationships, "is_current", F.lit(True)) == F.lit(False)) | (F.trim(_optional(relationships, "date_end", F.lit("")).cast("string")) != "")
    a, b = F.col("_source_born"), F.col("_target_born")
    both = (a != "") & (b != "")
    turn = (is_ == "created") & kinds("project", "person")
    relation = (
        F.when(is_.isin("product_of", "founded") & kinds("person", "project"), "created").when((is_ == "works_at") & ended, "worked_at")
        .when((is_ == "parent_of") & both & (a > b), "child_of").when((is_ == "child_of") & both & (a < b), "parent_of").otherwise(is_)
    )
    turned = rows.select(
        *[F.when(turn, F.col("target")).otherwise(F.col("source")).alias(c) if c == "source" else F.when(turn, F.col("source")).otherwise(F.col("target")).alias(c) if c == "target" else relation.alias(c) if c == "relation" else F.col(f"`{c}`") for c in relationships.columns]
    )
    return first_by(turned.where(F.col("relation").isin(CANONICAL_RELATIONS)), edge_key())


def restricted(entities: DataFrame, relationships: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships whose two ends are entities of their document, facts of such a subject), the first of each."""
    names = entities.select("doc", low("name").alias("_low")).distinct()
    own = lambda df, side: df.withColumn("_low", low(side)).join(names, ["doc", "_low"], "left_semi").drop("_low")
    rels = first_by(own(own(relationships, "source"), "target"), edge_key())
    return rels, first_by(own(facts, "subject"), [F.col("doc"), low("subject"), F.col("property")])


def compact(docs: DataFrame, entities: DataFrame, relationships: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, facts) of each document after compaction."""
    left = kept(compact_entities(docs, entities, relationships, facts))
    return left, *restricted(left, relationships, facts)
