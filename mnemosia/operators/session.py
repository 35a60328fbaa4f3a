"""What a chat session asks of the memory: its context as columns, hits of several sources as one list.

A table of questions (query_id, text, entities, messages, work: arrays of texts) is answered in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items of each list, characters of an item and of a query's form, forms of a query; words that speak for files and for the graph.
ENTITIES, MESSAGES, WORK, ITEM_CHARS, FORM_CHARS, FORMS = 6, 4, 4, 240, 500, 4
FILE_WORDS = r"(file|files|repo|repository|code|implement|fix|task|todo|worktree|path|folder|docs?|runbook|memory\.md)"
FILE_WORK = r"(file|repo|code|task|branch|path|folder|docs?)"
GRAPH_WORDS = r"(who is|what is|relationship|related|entity|person|org|project|history|timeline)"


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _first_of_each(c: Column) -> Column:
    """The items without those that equal an earlier one but for case."""
    return F.filter(c, lambda x, i: ~F.exists(F.slice(c, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def picked(c: Column, most: int) -> Column:
    """The first `most` different items of a list, each on one line and cut; without empty ones. Null is no list."""
    lines = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.left(_one_line(F.coalesce(x, F.lit(""))), F.lit(ITEM_CHARS)))
    return F.slice(_first_of_each(F.filter(lines, lambda x: x != "")), 1, most)


def retrieval_context(queries: DataFrame) -> DataFrame:
    """query_id, text, entities, messages, work, source (file, graph or both) and forms: what to search for, at most four."""
    rows = queries.select("query_id", "text", picked(F.col("entities"), ENTITIES).alias("entities"), picked(F.col("messages"), MESSAGES).alias("messages"), picked(F.col("work"), WORK).alias("work"))
    q, first = F.lower("text"), lambda c: F.get(c, F.lit(0))
    files = q.rlike(FILE_WORDS) | F.lower(F.array_join("work", " ")).rlike(FILE_WORK)
    graph = q.rlike(GRAPH_WORDS) | (F.size("entities") > 0)
    forms = F.array(
        F.col("text"), F.when(F.size("entities") > 0, F.concat_ws(" ", "text", F.array_join(F.slice("entities", 1, 3), " "))),
        F.when(F.size("work") > 0, F.concat_ws(" ", F.col("text"), first("work"))), F.when(F.size("messages") > 0, F.concat_ws(" ", F.col("text"), first("messages"))),
    )
    lines = F.filter(F.transform(F.array_compact(forms), lambda x: F.left(_one_line(x), F.lit(FORM_CHARS))), lambda x: x != "")
    source = F.when(files & ~graph, "file").when(graph & ~files, "graph").otherwise("both")
    return rows.withColumn("source", source).withColumn("lines", lines).select("query_id", "text", "entities", "messages", "work", "source", F.slice(_first_of_each(F.col("lines")), 1, FORMS).alias("forms"))


def best_of_forms(hits: DataFrame) -> DataFrame:
    """query_id, source, key, score: each source's best score of a key over a query's forms (query_id, form, source, key, score)."""
    return hits.groupBy("query_id", "source", "key").agg(F.max("score").alias("score"))


def unified(merged: DataFrame, min_score: float = 0.0, limit: int = 20) -> DataFrame:
    """The merged hits (query_id, key, source, score) of at least min_score, the first `limit` of each query, with rank and why."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    why = F.when(F.col("source") == "file", "file-memory match").otherwise("knowledge-graph match")
    return merged.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "key", "source", "score", "rank", why.alias("why"))
