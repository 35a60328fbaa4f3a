"""Search as callers see it: variants of a query, shaping, rescue by label, neighbours.

Every operator takes a table of queries (query_id, text) and answers all of them in
one plan. A query's variants are tried as rows; of those with any hit the first one
counts. Lists are joined in the order of their sources, without repeats. A list that is
read twice is kept in the checkpoint folder: it has as many rows as queries times the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemosia.functions.text import bound, intent_of, query_variants, title_words

from . import postings as stored_postings, rank, search, shaping
from .graph import dealt, kept
from .listing import node_by_label

#: Least salience by intent where none is asked for, most labels that are rescued, seeds and edges of the expansion (fixed values).
LEAST_SALIENCE = {"procedural": 1.0, "temporal": 0.5}
RESCUED, SEEDS, SEED_EDGES = 3, 5, 3


def variant_rows(queries: DataFrame) -> DataFrame:
    """query_id, variant (from 0, longest first), text; a query without variants is tried as it is.

    Making them costs far more than reading a query, so queries are dealt over all tasks first, however few bytes they have."""
    forms = bound(query_variants(F.col("text")), lambda made: F.when(F.size(made) == 0, F.array("text")).otherwise(made))
    return dealt(queries.select("query_id", "text"), "query_id").select("query_id", F.posexplode(forms).alias("variant", "text"))


def least_salience(queries: DataFrame, asked: float = 0.0) -> DataFrame:
    """query_id, least: what was asked for, or what the query's intent wants."""
    least = F.lit(float(asked))
    if asked <= 0:
        intent = intent_of(F.col("text"))
        least = F.lit(0.0)
        for kind, value in LEAST_SALIENCE.items():
            least = F.when(intent == kind, value).otherwise(least)
    return queries.select("query_id", least.alias("least"))


def first_text_hits(nodes: DataFrame, aliases: DataFrame | None, queries: DataFrame, limit: int = 20, kind: str = "", min_salience: float = 0.0, stemmed: bool = True, postings: stored_postings.Postings | None = None) -> DataFrame:
    """query_id, id, match, score, rank: the full-text hits of the first variant that has any; from stored postings if there are any."""
    rows = nodes.where(F.col("type") == kind) if kind else nodes
    asked = variant_rows(queries).select(F.struct("query_id", "variant").alias("query_id"), "text")
    if postings is not None:
        hits = stored_postings.matches(postings, aliases, asked)
    else:
        hits = search.text_hits(rows, asked, stemmed)
        if aliases is not None:
            hits = hits.unionByName(search.alias_hits(aliases, asked, stemmed))
    best = hits.groupBy("query_id", "id").agg(F.max("match").alias("match")).select("query_id.query_id", "query_id.variant", "id", "match")
    met = best.join(rows.select("id", "salience_score", "updated_at"), "id").join(least_salience(queries, min_salience), "query_id").where(F.col("salience_score") >= F.col("least"))
    first = search.first_variant(met)
    scored = first.withColumn("score", F.round(F.col("match") * 0.8 + F.least(F.col("salience_score") / 100.0, F.lit(1.0)) * 0.2, 9))
    return search.top(scored, limit, F.desc("score"), F.desc("salience_score"), F.desc("updated_at"), F.asc("id")).select("query_id", "id", "match", "score", "rank")


def rescued(nodes: DataFrame, aliases: DataFrame, queries: DataFrame, phrases: list[str] = []) -> DataFrame:  # noqa: B006
    """query_id, id, rank: nodes whose label or alias is a variant of the query in title case, the first three, in the order of variants.

    phrases are further labels, which count where the query holds them in any case."""
    asked = variant_rows(queries).select("query_id", "variant", title_words(F.col("text")).alias("label"))
    for k, phrase in enumerate(phrases):
        held = queries.where(F.lower("text").contains(phrase.lower())).select("query_id", F.lit(1_000_000 + k).alias("variant"), F.lit(phrase).alias("label"))
        asked = asked.unionByName(held)
    asked = asked.where(F.trim("label") != "").groupBy("query_id", "label").agg(F.min("variant").alias("variant"))
    found = asked.join(node_by_label(nodes, aliases, asked.select("label")), "label")
    w = Window.partitionBy("query_id").orderBy("variant")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= RESCUED).select("query_id", "id", "rank")


def appended(primary: DataFrame, extra: DataFrame, limit: int) -> DataFrame:
    """query_id, id, rank: the primary list, then what of extra (query_id, id, rank) it lacks, both by rank."""
    both = primary.select("query_id", "id", F.lit(0).alias("src"), "rank").unionByName(extra.select("query_id", "id", F.lit(1).alias("src"), "rank"))
    once = both.groupBy("query_id", "id").agg(F.min(F.struct("src", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "id", "rank")


def expanded(nodes: DataFrame, edges: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """found with the neighbours of its first nodes at the end, by salience and time."""
    seeds = found.where(F.col("rank") <= SEEDS).select("query_id", "id")
    near = rank.expansion(edges, seeds, SEED_EDGES).join(nodes.select("id", "salience_score", "updated_at"), "id")
    return rank.merge_expanded(found, near, limit).select("query_id", "id", "rank")


def full_text_service(
    nodes: DataFrame, aliases: DataFrame, edges: DataFrame, queries: DataFrame, limit: int = 20, kind: str = "", min_salience: float = 0.0, stemmed: bool = True,
    postings: stored_postings.Postings | None = None, beliefs: DataFrame | None = None,
) -> DataFrame:
    """query_id, id, rank: text hits shaped by time and beliefs, labels, neighbours."""
    found = kept(first_text_hits(nodes, aliases, queries, limit, kind, min_salience, stemmed, postings))
    found = shaping.shaped(found, queries, nodes, beliefs, limit)
    return expanded(nodes, edges, kept(appended(found, rescued(nodes, aliases, queries), limit)), limit)


def semantic_service(vectors: DataFrame, queries: DataFrame, embedded: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, id, score, rank: near the longest variant; embedded has text, embedding of those."""
    longest = variant_rows(queries).where("variant = 0").join(embedded, "text").select("query_id", "embedding")
    return search.semantic(vectors, longest, limit)


def hybrid_service(nodes: DataFrame, aliases: DataFrame, edges: DataFrame, vectors: DataFrame, queries: DataFrame, embedded: DataFrame, limit: int = 10, stemmed: bool = True, beliefs: DataFrame | None = None, rerank: str | None = None) -> DataFrame:
    """query_id, id, rank: text and vector hits fused, shaped by time and beliefs or, with the name of a profile in
    `rerank`, re-ranked from more of them, then labels and neighbours.

    The text side is that of the longest variant, since with a vector side it always has hits; a query without
    vector hits has those of the first variant with any."""
    most = limit if rerank is None else shaping.rerank_limit(limit)
    near = kept(semantic_service(vectors, queries, embedded, most))
    longest = variant_rows(queries).where("variant = 0").select("query_id", "text").join(near.select("query_id").distinct(), "query_id", "left_semi")
    text = search.full_text(nodes, aliases, longest, limit=most, stemmed=stemmed)
    alone = queries.join(near.select("query_id").distinct(), "query_id", "left_anti")
    text = text.unionByName(first_text_hits(nodes, aliases, alone, most, stemmed=stemmed))
    found = kept(search.hybrid(text, near, nodes, most))
    found = shaping.shaped(found, queries, nodes, beliefs, limit) if rerank is None else shaping.reranked(found, queries, nodes, beliefs, rerank, limit)
    return expanded(nodes, edges, kept(appended(found, rescued(nodes, aliases, queries), limit)), limit)
