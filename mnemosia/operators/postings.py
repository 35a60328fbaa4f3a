"""Stored postings of texts, and full-text search over them.

A posting says at which places of a text a lexeme stands. Postings are written once, in buckets by lexeme and as lists
of the texts of a batch, so that a search shuffles its queries and not the texts: each query starts from its rarest lexeme's postings and meets the
others' by (lexeme, text). A match's rank grows with how near its lexemes stand to each other.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemosia.functions.text import lexemes, normalize_alias, stemmed_word

from .graph import folder, kept
from .search import top

#: Least and most buckets, and bytes of texts for each.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_BYTES = 8, 2_000, 32_000_000
#: Fixed values of the rank: weight of a lexeme, places of one that count, the distance beyond which nearness is nil, what a lone lexeme's sum is divided by.
WEIGHT, MOST_PLACES, FAR, ALONE = 0.1, 255, 100, 1.64493406685
#: What an alias' rank counts, and an alias equal but for case, and in its normal form.
ALIAS_SHARE, SAME, SAME_NORMAL = 0.9, 1.0, 0.95
#: Words of texts that are placed at once, beyond a text of more.
BATCH_WORDS = 1_000_000


def _unpacked(places: bytes) -> np.ndarray:
    """Places as they are stored: numbers of four bytes, the lowest first."""
    return np.frombuffer(places, "<i4")


def _placed_batches(stemmed: bool):
    """A function of batches (id, ref, words): their postings, a row for each lexeme of a batch, so nothing is shuffled to bring a text's words together."""

    def postings_of(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = part["words"]
        coded = lists.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if stemmed:  # a word is stemmed once a batch
            own = pa.array([stemmed_word(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
            code, names = own.indices.to_numpy().astype(np.int64)[code], own.dictionary
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        key = code * len(sizes) + row
        order = np.argsort(key, kind="stable")  # by lexeme and text; places stay in their order
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        runs = np.diff(starts, append=len(order))
        few = np.arange(len(order)) - np.repeat(starts, runs) < MOST_PLACES
        ends = np.concatenate([[0], np.cumsum(np.minimum(runs, MOST_PLACES))]).astype(np.int32)
        first = order[starts]
        text = pa.array(row[first])
        places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends * 4), pa.py_buffer(at[order][few].astype("<i4"))])
        texts = pa.StructArray.from_arrays([part["id"].take(text), part["ref"].take(text), places], ["id", "ref", "places"])
        heads = np.flatnonzero(np.diff(code[first], prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(first)).astype(np.int32)), texts)
        return pa.RecordBatch.from_arrays([names.take(pa.array(code[first][heads])), lists], ["lexeme", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = np.cumsum(batch["words"].value_lengths().to_numpy()), 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_WORDS, "right")) - at)
                yield postings_of(batch.slice(at, n))
                at += n

    return run


def placed(texts: DataFrame, stemmed: bool = True) -> DataFrame:
    """lexeme, texts (id, ref, places) of texts (id, ref, text), a lexeme in several rows: its sorted places among all words of two bytes or more."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) >= 2)
    rows = texts.where("text IS NOT NULL").select(F.col("id").cast("string").alias("id"), "ref", words.alias("words"))
    return rows.mapInArrow(_placed_batches(stemmed), "lexeme string, texts array<struct<id: string, ref: string, places: binary>>")


def _merged(rows: DataFrame) -> DataFrame:
    """The rows of `placed` for texts of which several have one id and ref: they count as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [np.sort(_unpacked(b"".join(own)))[:MOST_PLACES].tobytes() for own in b["places"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["lexeme"], b["id"], b["ref"], pa.array(places, pa.binary())], ["lexeme", "id", "ref", "places"])

    each = rows.select("lexeme", F.inline("texts")).groupBy("lexeme", "id", "ref").agg(F.collect_list("places").alias("places"))
    return each.mapInArrow(run, "lexeme string, id string, ref string, places binary").select("lexeme", F.array(F.struct("id", "ref", "places")).alias("texts"))


@dataclass
class Postings:
    """rows: lexeme, texts (id, ref, places), a lexeme in several rows; counts: lexeme, texts. ref is '' for a node's text and the alias for an alias."""

    rows: DataFrame
    counts: DataFrame
    stemmed: bool


def build(nodes: DataFrame, aliases: DataFrame | None = None, stemmed: bool = True, buckets: int | None = None) -> Postings:
    """Postings of nodes (id, search_text) and aliases (node_id, alias), stored in the checkpoint folder, in buckets by the texts' size unless told otherwise."""
    spark = nodes.sparkSession
    texts = nodes.select("id", F.lit("").alias("ref"), F.col("search_text").alias("text"))
    if aliases is not None:
        own = aliases.select(F.col("node_id").alias("id"), F.col("alias").alias("ref"), F.col("alias").alias("text"))
        texts = texts.unionByName(own.where(F.trim("ref") != "").distinct())
    name = f"postings_{uuid.uuid4().hex}"
    sizes = texts.groupBy("id", "ref").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).agg(F.max("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, (sizes["bytes"] or 0) // BUCKET_BYTES))
    out = placed(texts, stemmed)
    out = (_merged(out) if (sizes["n"] or 0) > 1 else out).repartition(buckets, "lexeme")
    out.write.bucketBy(buckets, "lexeme").sortBy("lexeme").option("path", f"{folder(spark)}/{name}").saveAsTable(name)
    rows = spark.table(name)
    return Postings(rows, kept(rows.groupBy("lexeme").agg(F.sum(F.size("texts")).alias("texts"))), stemmed)


#: What a pair of places leaves, by their distance; the last holds beyond FAR. What n places of a lone lexeme add up to.
_LEFT = np.array([1.0 - 1e-15 * WEIGHT, *[1.0 - WEIGHT * math.sqrt(1.0 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))) for d in range(1, FAR + 1)], 1.0 - 1e-15 * WEIGHT])
_SUMS = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, MOST_PLACES + 1) ** 2)]) * WEIGHT / ALONE


def text_rank(places: list[bytes]) -> float:
    """Rank of a text that has all lexemes of a query, by their places.

    One lexeme alone: the sum of 1 / n ** 2 over its occurrences. Several: 1 - the product over all pairs of places of
    two lexemes of 1 minus a weight that falls with their distance."""
    own = [_unpacked(p) for p in places]
    if len(own) == 1:
        return float(_SUMS[len(own[0])])
    left = 1.0
    for a, b in itertools.combinations(own, 2):
        left *= float(_LEFT[np.minimum(np.abs(a[:, None] - b), FAR + 1)].prod())
    return 1.0 - left


def ranked(met: DataFrame) -> DataFrame:
    """met (query_id, id, ref, places) with match in place of the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            match = pa.array([text_rank(own) for own in b["places"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b["query_id"], b["id"], b["ref"], match], ["query_id", "id", "ref", "match"])

    schema = T.StructType([*[met.schema[c] for c in ("query_id", "id", "ref")], T.StructField("match", T.DoubleType())])
    return met.select("query_id", "id", "ref", "places").mapInArrow(run, schema)


def hits(postings: Postings, queries: DataFrame) -> DataFrame:
    """query_id, id, ref, match: the texts that have all lexemes of a query (query_id, text), with their rank."""
    asked = queries.select("query_id", lexemes(F.col("text"), postings.stemmed).alias("q")).where(F.size("q") > 0).select("query_id", F.size("q").alias("need"), F.explode("q").alias("lexeme"))
    known = asked.join(postings.counts, "lexeme")
    first = known.groupBy("query_id").agg(F.min(F.struct("texts", "lexeme"))["lexeme"].alias("lexeme"), F.first("need").alias("need"), F.count("*").alias("have"), F.collect_list("lexeme").alias("all"))
    first = kept(first.where("have = need").drop("have"))
    # stored rows stay in their buckets: only the asked lexemes are shuffled and hashed
    start = kept(postings.rows.join(first.hint("shuffle_hash"), "lexeme").select("query_id", "need", "lexeme", "all", F.inline("texts")))
    one = start.where("need = 1").select("query_id", "id", "ref", F.array("places").alias("places"))
    more = start.where("need > 1")
    others = F.array_except("all", F.array("lexeme"))
    # kept, since a list that is already dealt over more tasks than there are buckets would have the stored rows shuffled
    wanted = kept(first.where("need > 1").select(F.explode(others).alias("lexeme")).distinct())
    held = postings.rows.join(wanted.hint("shuffle_hash"), "lexeme", "left_semi").select("lexeme", F.inline("texts"))
    rest = more.select("query_id", "need", "id", "ref", F.explode(others).alias("lexeme")).join(held, ["lexeme", "id", "ref"]).select("query_id", "need", "id", "ref", "lexeme", "places")
    met = more.select("query_id", "need", "id", "ref", "lexeme", "places").unionByName(rest).groupBy("query_id", "need", "id", "ref").agg(F.array_sort(F.collect_list(F.struct("lexeme", "places"))).alias("found"))
    met = met.where(F.size("found") == F.col("need")).select("query_id", "id", "ref", F.transform("found", lambda x: x["places"]).alias("places"))
    return ranked(one.unionByName(met))


def matches(postings: Postings, aliases: DataFrame | None, queries: DataFrame) -> DataFrame:
    """query_id, id, match: the best of a node's text, its aliases' texts and aliases equal to the query."""
    found = hits(postings, queries).select("query_id", "id", F.when(F.col("ref") == "", F.col("match")).otherwise(F.col("match") * ALIAS_SHARE).alias("match"))
    if aliases is not None:
        asked = queries.select("query_id", F.lower("text").alias("low"), normalize_alias(F.col("text")).alias("norm"))
        same = asked.join(aliases.select(F.lower("alias").alias("low"), F.col("node_id").alias("id")), "low").select("query_id", "id", F.lit(SAME).alias("match"))
        normal = asked.join(aliases.select(F.col("normalized_alias").alias("norm"), F.col("node_id").alias("id")), "norm").select("query_id", "id", F.lit(SAME_NORMAL).alias("match"))
        found = found.unionByName(same).unionByName(normal)
    return found.groupBy("query_id", "id").agg(F.max("match").alias("match"))


def search(postings: Postings, nodes: DataFrame, aliases: DataFrame | None, queries: DataFrame, kind: str = "", min_salience: float = 0.0, limit: int = 20) -> DataFrame:
    """query_id, id, match, score, rank: 0.8 match + 0.2 salience (of 100), by score. nodes: id, type, salience_score, updated_at."""
    rows = nodes.where(F.col("type") == kind) if kind else nodes
    rows = rows.where(F.col("salience_score") >= min_salience) if min_salience > 0 else rows
    scored = matches(postings, aliases, queries).join(rows.select("id", "salience_score", "updated_at"), "id")
    scored = scored.withColumn("score", F.round(F.col("match") * 0.8 + F.least(F.col("salience_score") / 100.0, F.lit(1.0)) * 0.2, 9))
    return top(scored, limit, F.desc("score"), F.desc("salience_score"), F.desc("updated_at"), F.asc("id")).select("query_id", "id", "match", "score", "rank")
