"""Shaping and re-ranking of search results, each query by its own words.

Intent and time hints are columns of the query, so one plan ranks queries of every kind. Candidates are
(query_id, id, rank) lists of bounded length; nodes have id, label, search_text, user_boosted, salience_score,
updated_at, created_at; queries query_id and text; beliefs as for `rank.belief_score`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosia.functions.text import YEAR, temporal_hints

from .rank import PROFILES, TEMPORAL_CAP, belief_score, clamp

#: Candidates of a re-ranking: so many times the limit, and at most so many (fixed values).
FACTOR, MOST = 3, 50
_NODE = ["label", "search_text", "user_boosted", "salience_score", "updated_at", "created_at"]


def rerank_limit(limit: int) -> int:
    """How many candidates a re-ranking looks at."""
    return min(FACTOR * limit, MOST)


def _met(candidates: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    own = nodes.select("id", *[F.col(c) if c in nodes.columns else F.col("updated_at").alias(c) if c == "created_at" else F.lit(None).cast("boolean" if c == "user_boosted" else "string").alias(c) for c in _NODE])
    return candidates.select("query_id", "id", "rank").join(queries.select("query_id", F.col("text").alias("asked"), temporal_hints(F.col("text")).alias("hints")), "query_id").join(own, "id")


def _year_points(year: Column, hint: Column) -> Column:
    d = F.abs(year - hint)
    return F.when(d == 0, 0.45).when(d == 1, 0.18).when(d <= 3, 0.08).otherwise(-F.least(d / 20.0, F.lit(0.2)))


def temporal_points() -> Column:
    """By the query's hints: how recent or old the node is among the query's candidates, and how near its years are to those named."""
    anchor = F.unix_timestamp(F.coalesce("updated_at", "created_at").cast("timestamp"))
    w = Window.partitionBy("query_id")
    low, high = F.min(anchor).over(w), F.max(anchor).over(w)
    place = F.least(F.greatest((anchor - low) / F.nullif(high - low, F.lit(0)), F.lit(0.0)), F.lit(1.0))
    zero = F.lit(0.0)
    named = F.transform(F.regexp_extract_all(F.coalesce("search_text", F.lit("")), F.lit(YEAR), F.lit(0)), lambda y: y.cast("int"))
    own = F.array_compact(F.concat(named, F.array(F.year("updated_at"), F.year("created_at"))))
    best = F.greatest(F.lit(-0.2), F.array_max(F.transform(own, lambda y: F.array_max(F.transform(F.col("hints.years"), lambda h: _year_points(y, h))))))
    score = (
        F.lit(0.08) / F.col("rank")
        + F.when(F.col("hints.recent"), F.coalesce(place * 0.35, zero)).otherwise(zero)
        + F.when(F.col("hints.historical"), F.coalesce((1.0 - place) * 0.35, zero)).otherwise(zero)
        + F.when(F.size("hints.years") > 0, F.coalesce(best, F.lit(-0.2))).otherwise(zero)
    )
    timed = F.col("hints.recent") | F.col("hints.historical") | (F.size("hints.years") > 0)
    return F.when(timed, clamp(score, TEMPORAL_CAP)).otherwise(zero)


def prototype_points(profile: str = "default") -> tuple[Column, Column]:
    """(points of label and text by the query's terms, how many terms it has)."""
    p = PROFILES.get(profile.strip().lower() or "default", PROFILES["default"])
    q = F.lower(F.trim("asked"))
    terms = F.array_distinct(F.filter(F.split(F.lower("asked"), r"[\W_]+"), lambda t: F.octet_length(t) >= 2))
    label, text = F.lower(F.trim(F.coalesce("label", F.lit("")))), F.lower(F.coalesce("search_text", F.lit("")))
    point = lambda t: F.when(label.contains(t), F.lit(float(p["label_term"]))).when(text.contains(t), F.lit(float(p["text_term"]))).otherwise(F.lit(0.0))
    sums = F.aggregate(terms, F.lit(0.0), lambda s, t: s + point(t))
    matched = F.size(F.filter(terms, lambda t: label.contains(t) | text.contains(t)))
    score = (
        sums + F.coalesce(F.try_divide(matched, F.size(terms)) * p["coverage"], F.lit(0.0))
        + F.when(label == q, p["exact"]).otherwise(0) + F.when(label.contains(q), p["contains"]).otherwise(0) + F.when(F.col("user_boosted"), p["boost"]).otherwise(0)
        + F.least(F.coalesce("salience_score", F.lit(0.0)) / p["divisor"], F.lit(float(p["cap"]))) + F.lit(float(p["bias"])) / F.col("rank")
    )
    return score, F.size(terms)


def _believed(met: DataFrame, beliefs: DataFrame | None) -> DataFrame:
    if beliefs is None:
        return belief_score(met, met.sparkSession.createDataFrame([], "id string, status string, evidence_count long, preferred_confidence double, matches_current boolean, last_observed timestamp_ntz"))
    return belief_score(met, beliefs)


def _ranked(scored: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("salience_score"), F.desc("updated_at"), F.asc("id"))
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("query_id", "id", "score", F.col("_n").alias("rank"))


def shaped(candidates: DataFrame, queries: DataFrame, nodes: DataFrame, beliefs: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """query_id, id, score, rank: by what is believed of a node and, for a query with time hints, by its time."""
    met = _met(candidates, queries, nodes).withColumn("temporal", temporal_points())
    return _ranked(_believed(met, beliefs).withColumn("score", F.round(F.col("belief") + F.col("temporal"), 9)), limit)


def reranked(candidates: DataFrame, queries: DataFrame, nodes: DataFrame, beliefs: DataFrame | None = None, profile: str = "default", limit: int = 20) -> DataFrame:
    """query_id, id, score, rank: the first rerank_limit candidates by the query's terms and what is believed; by their rank where a query has no terms."""
    points, n_terms = prototype_points(profile)
    met = _met(candidates.where(F.col("rank") <= rerank_limit(limit)), queries, nodes).withColumn("prototype", points).withColumn("n_terms", n_terms)
    scored = _believed(met, beliefs)
    return _ranked(scored.withColumn("score", F.when(F.col("n_terms") > 0, F.round(F.col("prototype") + F.col("belief"), 9)).otherwise(-F.col("rank").cast("double"))), limit)
