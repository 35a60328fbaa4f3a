"""Full-text, vector and hybrid search, for one query or a table of queries.

A query table has query_id and text (and embedding); every operator works for
all its rows in one plan. Texts are matched through lexemes: the nodes' lexemes
are joined with one of each query's by equality, so nodes are scanned once
whatever the number of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemosia.functions.text import lexemes, normalize_alias

RRF_K = 60
#: Vectors and query vectors of a block, queries that meet a block at once, pairs that are scored again at once.
VECTOR_ROWS, QUERY_ROWS, QUERY_CHUNK, PAIRS = 8_192, 4_096, 256, 65_536
#: How far a score may be behind the last of the first ones before rounding to six digits.
MARGIN = 2e-6


def text_hits(nodes: DataFrame, queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """query_id, id, match: nodes whose text (search_text) has all lexemes of the query.

    match is the share of the node's lexemes that the query names, in (0, 1]. Queries
    without lexemes hit nothing."""
    asked = queries.select("query_id", lexemes(F.col("text"), stemmed).alias("q")).where(F.size("q") > 0)
    # a node is looked up by the query's longest lexeme only, which is likely a rare one, and then must have all
    longest = F.array_max(F.transform("q", lambda x: F.struct(F.length(x).alias("n"), x.alias("lexeme"))))
    asked = asked.select("query_id", "q", longest["lexeme"].alias("lexeme"))
    have = nodes.select("id", lexemes(F.col("search_text"), stemmed).alias("l")).select("id", "l", F.explode("l").alias("lexeme"))
    met = have.join(asked, "lexeme").where(F.size(F.array_except("q", "l")) == 0)
    return met.select("query_id", "id", (F.size("q") / F.size("l")).alias("match"))


def alias_hits(aliases: DataFrame, queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """query_id, id, match: 1.0 for an alias equal but for case, 0.95 for an equal normalised alias, else 0.9 times its text match."""
    asked = queries.select("query_id", "text", F.lower("text").alias("low"), normalize_alias(F.col("text")).alias("norm"))
    exact = asked.join(aliases.select(F.lower("alias").alias("low"), F.col("node_id").alias("id")), "low").select("query_id", "id", F.lit(1.0).alias("match"))
    norm = asked.join(aliases.select(F.col("normalized_alias").alias("norm"), F.col("node_id").alias("id")), "norm").select("query_id", "id", F.lit(0.95).alias("match"))
    text = text_hits(aliases.select(F.col("node_id").alias("id"), F.col("alias").alias("search_text")).distinct(), queries, stemmed)
    return exact.unionByName(norm).unionByName(text.select("query_id", "id", (F.col("match") * 0.9).alias("match")))


def top(scored: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first `limit` rows of each query in the order, with rank from 1."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def full_text(nodes: DataFrame, aliases: DataFrame | None, queries: DataFrame, kind: str = "", min_salience: float = 0.0, limit: int = 20, stemmed: bool = True) -> DataFrame:
    """query_id, id, match, score, rank: 0.8 match + 0.2 salience (of 100), by score."""
    if kind:
        nodes = nodes.where(F.col("type") == kind)
    if min_salience > 0:
        nodes = nodes.where(F.col("salience_score") >= min_salience)
    hits = text_hits(nodes, queries, stemmed)
    if aliases is not None:
        hits = hits.unionByName(alias_hits(aliases, queries, stemmed))
    best = hits.groupBy("query_id", "id").agg(F.max("match").alias("match"))
    scored = best.join(nodes.select("id", "salience_score", "updated_at"), "id")
    scored = scored.withColumn("score", F.round(F.col("match") * 0.8 + F.least(F.col("salience_score") / 100.0, F.lit(1.0)) * 0.2, 9))
    return top(scored, limit, F.desc("score"), F.desc("salience_score"), F.desc("updated_at"), F.asc("id")).select("query_id", "id", "match", "score", "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of columns, added up as `dot` does, so that scores are the same to the last digit."""
    total = np.zeros(a.shape[1])
    for x, y in zip(a, b):
        total += x * y
    return total


def _matrix(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as columns, their norms)."""
    flat = rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    columns = np.ascontiguousarray(flat.reshape(rows.num_rows, -1).T)
    return columns, np.sqrt(_sequential(columns, columns))


def _nearest(limit: int):
    """A function of (vectors, queries) of one block each: the pairs that can be among the first `limit` of a query, with their scores."""

    def near(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("id")
        v, norm = _matrix(vectors, "v")
        # of equal vectors only those with the least ids can be among the first
        _, same = np.unique(v.T.copy().view(np.dtype((np.void, v.shape[0] * 8))).ravel(), return_inverse=True)
        order = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(same[order]) > 0])
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        rows = np.sort(order[place < limit])
        v, norm = np.ascontiguousarray(v[:, rows]), norm[rows]
        q, q_norm = _matrix(queries, "q")
        plain = lambda n: (n > 1e-100) & (n < 1e100)
        unit = np.where(plain(norm), v / np.where(plain(norm), norm, 1.0), 0.0)
        found = [], [], []
        for at in range(0, q.shape[1], QUERY_CHUNK):
            part, n = q[:, at : at + QUERY_CHUNK], q_norm[at : at + QUERY_CHUNK]
            score = np.where(plain(n), part / np.where(plain(n), n, 1.0), 0.0).T @ unit
            known = plain(n)[:, None] & plain(norm)[None, :]
            score[~known] = -np.inf
            # scores are rounded to six digits later; what is this far behind the last of the first ones stays behind
            least = np.partition(score, -limit, axis=1)[:, -limit] - MARGIN if score.shape[1] > limit else np.full(score.shape[0], -np.inf)
            k, i = np.nonzero((score >= least[:, None]) | ~known)
            for cut in range(0, len(i), PAIRS):
                a, b = i[cut : cut + PAIRS], k[cut : cut + PAIRS]
                below = norm[a] * n[b]
                own = below != 0
                a, b = a[own], b[own]
                found[0].append(rows[a])
                found[1].append(b + at)
                found[2].append(_sequential(v[:, a], part[:, b]) / below[own])
        i, k, score = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in found)
        return pa.table({"query_id": queries["query"].take(pa.array(k)), "id": vectors["id"].take(pa.array(i)), "score": pa.array(score.astype(np.float64))})

    return near


def semantic(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, id, score, rank: cosine similarity, exact. Null and zero vectors, vectors with a null and vectors of other
    length than the query's are left out.

    Every query (query_id, embedding) meets every vector, so the work grows with their product: blocks of VECTOR_ROWS
    vectors meet blocks of QUERY_ROWS queries, each pair of blocks in one group, by a product of two matrices. What may
    be among the first ones of a query is scored again as `dot` does, and leaves the group with its score."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    v = vectors.where(usable).select("id", F.col("embedding").alias("v"), F.size("embedding").alias("dim"))
    q = queries.where(usable).select(F.col("query_id").alias("query"), F.col("embedding").alias("q"), F.size("embedding").alias("q_dim"))
    blocks = lambda df, most: max(1, -(-df.count() // most))
    n_v, n_q = blocks(vectors, VECTOR_ROWS), blocks(queries, QUERY_ROWS)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("v_block", dealt("id", n_v)).withColumn("q_block", every(n_q))
    q = q.withColumn("met", every(n_v)).withColumn("own", dealt("query", n_q))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    nearest = _nearest(limit)

    def near(vs: pa.Table, qs: pa.Table) -> pa.Table:
        if vs.num_rows and qs.num_rows:
            return nearest(vs, qs)
        return pa.table({"query_id": qs["query"].slice(0, 0), "id": vs["id"].slice(0, 0), "score": pa.array([], pa.float64())})

    met = v.groupBy("dim", "v_block", "q_block").cogroup(q.groupBy("q_dim", "met", "own")).applyInArrow(near, schema)
    return top(met.withColumn("score", F.round("score", 6)), limit, F.desc("score"), F.asc("id")).select("query_id", "id", "score", "rank")


def hybrid(text: DataFrame, near: DataFrame, nodes: DataFrame, limit: int = 10, k: int = RRF_K) -> DataFrame:
    """query_id, id, rrf, score, rank: reciprocal-rank fusion of two ranked lists (query_id, id, rank),
    then 0.85 rrf + 0.15 salience (of 100)."""
    part = lambda df, name: df.where(F.col("rank") <= limit).select("query_id", "id", (F.lit(1.0) / (F.col("rank") + k)).alias(name))
    both = part(text, "t").join(part(near, "v"), ["query_id", "id"], "full_outer")
    fused = both.withColumn("rrf", F.coalesce("t", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))).join(nodes.select("id", "salience_score", "updated_at"), "id")
    scored = fused.withColumn("score", F.round(F.col("rrf") * 0.85 + F.least(F.col("salience_score") / 100.0, F.lit(1.0)) * 0.15, 9))
    return top(scored, limit, F.desc("score"), F.desc("salience_score"), F.desc("updated_at"), F.asc("id")).select("query_id", "id", F.round("rrf", 9).alias("rrf"), "score", "rank")


def first_variant(hits: DataFrame) -> DataFrame:
    """hits (query_id, variant, ...) of the least variant that has any, by query."""
    least = hits.groupBy("query_id").agg(F.min("variant").alias("variant"))
    return hits.join(least, ["query_id", "variant"])
