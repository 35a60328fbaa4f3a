"""Entity resolution: names to nodes by label, alias and trigram similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosia.functions.text import bound

from .graph import kept
from .listing import node_by_label
from .postings import Postings, build, matches
from .search import first_variant
from .service import least_salience, variant_rows

AUTO, KEEP, GAP_ABOVE, CANDIDATES = 0.93, 0.5, 0.04, 10

#: Endings of company names, taken off in this order (fixed values).
COMPANY_SUFFIXES = [
    ", incorporated", ", inc.", ", inc", " incorporated", " inc.", " inc", ", llc", " llc", ", ltd.", ", ltd", " ltd.", " ltd",
    " corporation", ", corp.", ", corp", " corp.", " corp", " co.", " company", " wireless", " communications", " technologies",
    " technology", " solutions", " services", " group", " holdings", " enterprises",
]


#: Whether any ending is there; most labels have none and are left after this one look.
_ANY_SUFFIX = "(?:" + "|".join(re.escape(s) for s in COMPANY_SUFFIXES) + ")$"


def normalize_label(c: Column) -> Column:
    def short(x: Column) -> Column:
        out = x
        for suffix in COMPANY_SUFFIXES:
            out = F.regexp_replace(out, re.escape(suffix) + "$", "")
        return F.when(x.rlike(_ANY_SUFFIX), out).otherwise(x)

    return F.trim(bound(F.lower(F.trim(c)), short))


def fuzzy_match(a: Column, b: Column) -> Column:
    """1.0 for equal normalised labels, 0.8 if one contains the other, else 0."""
    x, y = normalize_label(a), normalize_label(b)
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.8).otherwise(0.0)


def trigrams(c: Column) -> Column:
    """Every three characters of the text with two spaces on both sides."""
    padded = F.concat(F.lit("  "), c, F.lit("  "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of the trigram multisets; 0 if either is empty, 1 if equal."""
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    shared = lambda ga, gb: F.aggregate(F.array_intersect(ga, gb), F.lit(0), lambda s, g: s + F.least(count(ga, g), count(gb, g)))
    dice = bound(trigrams(a), lambda ga: bound(trigrams(b), lambda gb: shared(ga, gb) * 2.0 / (F.size(ga) + F.size(gb))))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(dice)


def candidate_score(query: Column, kind: Column, id_: Column, label: Column, node_type: Column, q: Column | None = None, n: Column | None = None) -> Column:
    """Confidence of a candidate node for a name, from 0 to 1; a type that differs costs, an equal one adds.

    q and n are the normalised name and label where the rows have them; the score names both several times."""
    q, n = normalize_label(query) if q is None else q, normalize_label(label) if n is None else n
    base = (
        F.when(query == id_, 1.0).when(F.lower(F.trim(query)) == F.lower(F.trim(label)), 0.99).when((q != "") & (q == n), 0.97)
        .when(q.contains(n) | n.contains(q), 0.88).otherwise(trigram_similarity(q, n) * 0.84)
    )
    typed = F.when(F.coalesce(kind, F.lit("")) == "", 0.0).when(F.lower(kind) == F.lower(node_type), 0.06).when(node_type != "", -0.08).otherwise(0.0)
    return F.least(F.greatest(base + typed, F.lit(0.0)), F.lit(1.0))


def _search_columns(nodes: DataFrame) -> DataFrame:
    """nodes with what a search needs, where it is missing: the label as text, full salience, no time."""
    have = nodes.columns
    return nodes.select(
        "id", "type", "label", (F.col("search_text") if "search_text" in have else F.col("label")).alias("search_text"),
        (F.col("salience_score") if "salience_score" in have else F.lit(100.0)).alias("salience_score"), (F.col("updated_at") if "updated_at" in have else F.lit(None).cast("timestamp_ntz")).alias("updated_at"),
    )


def search_candidates(names: DataFrame, nodes: DataFrame, aliases: DataFrame, limit: int = CANDIDATES, postings: Postings | None = None) -> DataFrame:
    """name_id, id: the first `limit` nodes that a search for a name (name_id, name) finds, by the first of the name's forms that has any.

    Forms are searched once whatever the number of names that have them, and each keeps its first hits only, so a word
    that very many nodes and names share costs its postings once."""
    rows = _search_columns(nodes)
    own = aliases if "alias" in aliases.columns else aliases.withColumn("alias", F.col("normalized_alias"))
    posted = build(rows, own) if postings is None else postings
    queries = names.select(F.col("name_id").alias("query_id"), F.col("name").alias("text"))
    forms = variant_rows(queries).join(least_salience(queries), "query_id")
    asked = kept(forms.select("text", "least").distinct())
    found = matches(posted, own, asked.select(F.col("text").alias("query_id"), "text").distinct()).withColumnRenamed("query_id", "text")
    met = found.join(rows.select("id", "salience_score", "updated_at"), "id").join(asked, "text").where(F.col("salience_score") >= F.col("least"))
    score = F.round(F.col("match") * 0.8 + F.least(F.col("salience_score") / 100.0, F.lit(1.0)) * 0.2, 9)
    w = Window.partitionBy("text", "least").orderBy(score.desc(), F.desc("salience_score"), F.desc("updated_at"), F.asc("id"))
    best = kept(met.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("text", "least", "id"))
    return first_variant(forms.join(best, ["text", "least"])).select(F.col("query_id").alias("name_id"), "id")


def decided(scored: DataFrame) -> DataFrame:
    """name_id, status, id, confidence, clear of candidates (name_id, id, confidence): the best of each name.

    One that reaches 0.93 and leads the next by 0.04 is a match; otherwise several are ambiguous, one alone is no match."""
    w = Window.partitionBy("name_id").orderBy(F.desc("confidence"), "id")
    top = scored.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("confidence").over(w)).withColumn("all", F.count("*").over(Window.partitionBy("name_id"))).where("n = 1")
    clear = (F.col("confidence") >= AUTO) & (F.col("next").isNull() | (F.round(F.col("confidence") - F.col("next"), 9) >= GAP_ABOVE))
    return top.select("name_id", F.when(clear, "match").when(F.col("all") > 1, "ambiguous").otherwise("no_match").alias("status"), "id", "confidence")


def _met(found: DataFrame, asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """found (name_id, id) with name, kind, label, type, and `score`, an array of the one score; names and labels are normalised once each, before they meet."""
    named = asked.select("name_id", "name", "kind", normalize_label(F.col("name")).alias("_q"))
    own = nodes.select("id", "type", "label", normalize_label(F.col("label")).alias("_n"))
    met = found.join(named, "name_id").join(own, "id")
    return met.withColumn("score", F.array(candidate_score(F.col("name"), F.col("kind"), F.col("id"), F.col("label"), F.col("type"), F.col("_q"), F.col("_n"))))


def scored_candidates(found: DataFrame, asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """name_id, id, confidence of pairs (name_id, id), those of 0.5 or more."""
    # a filter on the score itself would compute it a second time
    kept_ones = F.filter(F.transform("score", lambda c: F.round(c, 9)), lambda c: c >= KEEP)
    return _met(found, asked, nodes).select("name_id", "id", F.explode(kept_ones).alias("confidence"))


def resolve(names: DataFrame, nodes: DataFrame, aliases: DataFrame, postings: Postings | None = None, lookup: bool = False) -> DataFrame:
    """name_id, status, node_id, confidence for each row of names (name_id, name, kind).

    Candidates are nodes of that id, of an equal label or alias, and the first ten that a search for the name finds
    (the words of a name in any order, then each long word of it alone). See `decided` for the status. With `lookup`
    an id, and else the one node whose label or alias equals the name, settles it without a search."""
    asked = names.select("name_id", F.trim("name").alias("name"), "kind")
    labelled = node_by_label(nodes, aliases if "alias" in aliases.columns else aliases.withColumn("alias", F.col("normalized_alias")), asked.select(F.col("name").alias("label")))
    by_id = asked.join(nodes.select("id", F.col("id").alias("name")), "name").select("name_id", "id")
    by_label = asked.join(labelled, F.col("label") == F.col("name")).select("name_id", "id")
    settled = None
    if lookup:
        one = kept(by_id.select("name_id", "id", F.lit(0).alias("tier")).unionByName(by_label.select("name_id", "id", F.lit(1).alias("tier"))).groupBy("name_id").agg(F.min(F.struct("tier", "id")).alias("b")).select("name_id", "b.id", "b.tier"))
        alias = F.lower(F.trim("label")) != F.lower("name")
        confidence = F.transform("score", lambda own: F.when(F.col("tier") == 0, 1.0).when(alias, F.greatest(own, F.lit(0.96))).otherwise(own))
        settled = _met(one, asked, nodes).select("name_id", F.lit("match").alias("status"), "id", F.round(F.get(confidence, F.lit(0)), 9).alias("confidence"))
        asked = kept(asked.join(one.select("name_id"), "name_id", "left_anti"))
    normal = nodes.select("id", normalize_label(F.col("label")).alias("norm"))
    found = search_candidates(asked, nodes, aliases, postings=postings)
    if not lookup:
        same = asked.withColumn("norm", normalize_label(F.col("name"))).join(normal, "norm").select("name_id", "id")
        found = found.union(by_id).union(by_label).union(same).distinct()
    top = decided(scored_candidates(found, asked, nodes))
    top = top.unionByName(settled) if settled is not None else top
    return names.select("name_id").join(top, "name_id", "left").select("name_id", F.coalesce("status", F.lit("no_match")).alias("status"), F.when(F.col("status") == "match", F.col("id")).alias("node_id"), "confidence")
