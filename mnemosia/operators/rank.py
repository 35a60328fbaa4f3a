"""Re-ranking of search results: beliefs, time, terms; and merging of result lists.

Inputs are ranked candidates (query_id, id, rank from 1) joined with their
nodes; all scores are column arithmetic over bounded candidate lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosia.functions.text import YEAR, query_terms, temporal_profile

#: Weights of the belief-aware score (fixed values).
SUPPORTED, CONTESTED, SUPERSEDED = 0.32, -0.18, -0.3
PREFERRED_CURRENT, CONFIDENCE, EVIDENCE, RECENT, WINDOW_DAYS, BELIEF_CAP, BELIEF_BIAS = 0.08, 0.08, 0.05, 0.08, 365.0, 0.8, 0.35
TEMPORAL_CAP = 0.9
#: Weights of the profiles (fixed values).
PROFILES = {
    "default": {"exact": 10, "contains": 4, "label_term": 2.5, "text_term": 1.2, "coverage": 3, "boost": 0.4, "divisor": 100, "cap": 1.5, "bias": 1},
    "term_focus": {"exact": 10, "contains": 4, "label_term": 3.2, "text_term": 1.8, "coverage": 4.2, "boost": 0.3, "divisor": 140, "cap": 1.0, "bias": 0.8},
    "salience_focus": {"exact": 9, "contains": 3.5, "label_term": 2.1, "text_term": 1, "coverage": 2.5, "boost": 0.5, "divisor": 70, "cap": 2.2, "bias": 1.1},
}


def clamp(c: Column, most: float) -> Column:
    return F.least(F.greatest(c, F.lit(-most)), F.lit(most))


def belief_score(candidates: DataFrame, beliefs: DataFrame) -> DataFrame:
    """candidates with `belief`: 0.35 / rank plus the sum over the node's beliefs, clamped to 0.8.

    beliefs: id, status, evidence_count, preferred_confidence, matches_current, last_observed
    (timestamp), one row a property. Recency is relative to the latest observation among the
    query's candidates."""
    met = candidates.select("query_id", "id").join(beliefs, "id")
    freshest = F.max("last_observed").over(Window.partitionBy("query_id"))
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(freshest.cast("timestamp")) - F.unix_timestamp(F.col("last_observed").cast("timestamp"))) / 86400.0)
    status = F.when(F.col("status") == "supported", SUPPORTED).when(F.col("status") == "contested", CONTESTED).when(F.col("status") == "superseded", SUPERSEDED).otherwise(0.0)
    points = (
        status
        + F.least(F.coalesce("evidence_count", F.lit(0)), F.lit(4)) * EVIDENCE
        + F.least(F.greatest(F.coalesce("preferred_confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * CONFIDENCE
        + F.when(F.col("matches_current"), PREFERRED_CURRENT).otherwise(0.0)
        + F.when(F.col("last_observed").isNotNull(), F.greatest(F.lit(0.0), 1.0 - age / WINDOW_DAYS)).otherwise(0.0) * RECENT
    )
    sums = met.withColumn("points", points).groupBy("query_id", "id").agg(F.sum("points").alias("points"))
    joined = candidates.join(sums, ["query_id", "id"], "left")
    return joined.withColumn("belief", clamp(F.lit(BELIEF_BIAS) / F.col("rank") + F.coalesce("points", F.lit(0.0)), BELIEF_CAP)).drop("points")


def temporal_score(candidates: DataFrame, query: str) -> DataFrame:
    """candidates (query_id, id, rank, updated_at, created_at, search_text) with `temporal`, for one query's words."""
    recent, historical, years = temporal_profile(query)
    anchor = F.unix_timestamp(F.coalesce("updated_at", "created_at").cast("timestamp"))
    w = Window.partitionBy("query_id")
    low, high = F.min(anchor).over(w), F.max(anchor).over(w)
    place = F.least(F.greatest((anchor - low) / F.nullif(high - low, F.lit(0)), F.lit(0.0)), F.lit(1.0))
    score = F.lit(0.08) / F.col("rank")
    if recent:
        score = score + F.coalesce(place * 0.35, F.lit(0.0))
    if historical:
        score = score + F.coalesce((1.0 - place) * 0.35, F.lit(0.0))
    if years:
        named = F.transform(F.regexp_extract_all(F.coalesce("search_text", F.lit("")), F.lit(YEAR), F.lit(0)), lambda y: y.cast("int"))
        own = F.array_compact(F.concat(named, F.array(F.year("updated_at"), F.year("created_at"))))

        def points(y: Column) -> Column:
            best = F.lit(-0.2)
            for hint in years:
                d = F.abs(y - hint)
                best = F.greatest(best, F.when(d == 0, 0.45).when(d == 1, 0.18).when(d <= 3, 0.08).otherwise(-F.least(d / 20.0, F.lit(0.2))))
            return best

        score = score + F.coalesce(F.array_max(F.transform(own, points)), F.lit(-0.2))
    return candidates.withColumn("temporal", clamp(score, TEMPORAL_CAP))


def prototype_score(candidates: DataFrame, query: str, profile: str = "default") -> DataFrame:
    """candidates (id, rank, label, search_text, user_boosted, salience_score) with `prototype`."""
    p = PROFILES.get(profile.strip().lower() or "default", PROFILES["default"])
    terms, q = query_terms(query), query.strip().lower()
    label, text = F.lower(F.trim(F.coalesce("label", F.lit("")))), F.lower(F.coalesce("search_text", F.lit("")))
    score, matched = F.lit(0.0), F.lit(0)
    for t in terms:
        score = score + F.when(label.contains(t), p["label_term"]).when(text.contains(t), p["text_term"]).otherwise(0.0)
        matched = matched + (label.contains(t) | text.contains(t)).cast("int")
    if terms:
        score = score + matched / len(terms) * p["coverage"]
    score = score + F.when(label == q, p["exact"]).otherwise(0) + F.when(label.contains(q), p["contains"]).otherwise(0) + F.when(F.col("user_boosted"), p["boost"]).otherwise(0)
    return candidates.withColumn("prototype", score + F.least(F.coalesce("salience_score", F.lit(0.0)) / p["divisor"], F.lit(float(p["cap"]))) + F.lit(float(p["bias"])) / F.col("rank"))


def reordered(candidates: DataFrame, score: Column, limit: int) -> DataFrame:
    """By rounded score, salience, time of change and id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("salience_score"), F.desc("updated_at"), F.asc("id"))
    return candidates.withColumn("score", F.round(score, 9)).withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= limit)


def prototype_rerank(candidates: DataFrame, beliefs: DataFrame, query: str, profile: str = "default", limit: int = 20) -> DataFrame:
    """The candidates by prototype and belief score together, with score and new_rank; by their own rank if the query has no terms."""
    if not query_terms(query):
        return candidates.where(F.col("rank") <= limit).withColumn("score", F.lit(None).cast("double")).withColumn("new_rank", F.col("rank"))
    scored = belief_score(prototype_score(candidates, query, profile), beliefs)
    return reordered(scored, F.col("prototype") + F.col("belief"), limit)


def merge_expanded(primary: DataFrame, extra: DataFrame, limit: int) -> DataFrame:
    """query_id, id, rank: the primary list (query_id, id, rank), then extra nodes (query_id, id,
    salience_score, updated_at) by salience and time, without repeats."""
    zero = F.lit(None)
    a = primary.select("query_id", "id", F.lit(0).alias("src"), F.col("rank").alias("place"), zero.cast("double").alias("salience_score"), zero.cast("timestamp_ntz").alias("updated_at"))
    b = extra.join(primary.select("query_id", "id"), ["query_id", "id"], "left_anti").dropDuplicates(["query_id", "id"]).select("query_id", "id", F.lit(1).alias("src"), F.lit(0).alias("place"), F.col("salience_score").cast("double"), F.col("updated_at").cast("timestamp_ntz"))
    w = Window.partitionBy("query_id").orderBy("src", "place", F.desc("salience_score"), F.desc("updated_at"), "id")
    return a.unionByName(b).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "id", "src", "rank")


def expansion(edges: DataFrame, seeds: DataFrame, cap: int = 3) -> DataFrame:
    """query_id, id: neighbours of the seeds (query_id, id), up to `cap` edges of each direction by (source, target, relation)."""
    out = seeds.join(edges, seeds.id == edges.source).select("query_id", F.col("source").alias("seed"), F.col("target").alias("other"), "source", "target", "relation", F.lit(0).alias("d"))
    back = seeds.join(edges, seeds.id == edges.target).select("query_id", F.col("target").alias("seed"), F.col("source").alias("other"), "source", "target", "relation", F.lit(1).alias("d"))
    w = Window.partitionBy("query_id", "seed", "d").orderBy("source", "target", "relation")
    near = out.unionByName(back).withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    return near.where("other <> seed").select("query_id", F.col("other").alias("id")).distinct()


def merge_results(hits: DataFrame, weights: dict[str, float], intent_bonus: dict[tuple[str, str], float], context: DataFrame | None = None, boost: float = 0.1, limit: int = 20) -> DataFrame:
    """query_id, key, source, score, rank of hits (query_id, intent, source, key, score) from several sources.

    A score is times its source's weight, plus the bonus of (intent, source), plus `boost` if the
    key is in context (key); the best hit of a key stays."""
    weight, bonus = F.lit(1.0), F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, w).otherwise(weight)
    for (intent, name), b in intent_bonus.items():
        bonus = F.when((F.col("intent") == intent) & (F.col("source") == name), b).otherwise(bonus)
    scored = hits.withColumn("score", F.col("score") * weight + bonus)
    if context is not None:
        known = context.select("key").distinct().withColumn("known", F.lit(True))
        scored = scored.join(known, "key", "left").withColumn("score", F.col("score") + F.when(F.col("known"), boost).otherwise(0.0))
    best = scored.groupBy("query_id", "key").agg(F.max(F.struct("score", "source")).alias("b")).select("query_id", "key", "b.source", F.round("b.score", 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
