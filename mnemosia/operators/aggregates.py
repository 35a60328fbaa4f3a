"""Counts, feedback, evaluation and diagnostics."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, entity_types, embedded, avg_salience (cents, halves up; 0 without nodes): one row."""
    embedded = F.count_if(F.col("embedding").isNotNull()) if "embedding" in nodes.columns else F.lit(0).cast("long")
    left = nodes.agg(
        F.count("*").alias("nodes"), F.countDistinct("type").alias("entity_types"), embedded.alias("embedded"),
        (F.floor(F.coalesce(F.avg("salience_score"), F.lit(0.0)) * 100 + 0.5) / 100).alias("avg_salience"),
    )
    return left.join(F.broadcast(edges.agg(F.count("*").alias("edges"))))


def reprocess_counts(nodes: DataFrame) -> DataFrame:
    """missing_text, missing_embedding, missing_either, total: one row."""
    text, vector = F.coalesce(F.trim("search_text"), F.lit("")) == "", F.col("embedding").isNull()
    return nodes.agg(F.count_if(text).alias("missing_text"), F.count_if(vector).alias("missing_embedding"), F.count_if(text | vector).alias("missing_either"), F.count("*").alias("total"))


def retrieval_signals() -> Column:
    """Sorted signals of a feedback row (outcome, retrieved, selected, expected)."""
    none = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    overlap = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    outcome = F.lower(F.trim("outcome"))
    found = [
        F.when((outcome == "helpful") & (overlap("retrieved", "selected") | none(F.col("selected"))), "confirmed_recall"),
        F.when(none(F.col("retrieved")), "empty_result"),
        F.when((outcome == "unhelpful") & ~none(F.col("retrieved")), "irrelevant_result"),
        F.when((outcome == "missed") & ~none(F.col("expected")) & ~overlap("retrieved", "expected"), "missed_known_item"),
    ]
    return F.array_compact(F.array(*found))


def normalize_feedback_query(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def feedback_summary(feedback: DataFrame) -> dict[str, DataFrame]:
    """outcomes (outcome, n), signals (signal, n) and buckets by normalised query and mode."""
    rows = feedback.withColumn("normalized_query", normalize_feedback_query(F.col("query_text")))
    buckets = rows.groupBy("normalized_query", "search_mode").agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "helpful").alias("helpful"), F.count_if(F.col("outcome") == "unhelpful").alias("unhelpful"),
        F.count_if(F.col("outcome") == "missed").alias("missed"), F.max("created_at").alias("last_seen"), F.max_by("query_text", F.struct("created_at", "id")).alias("example"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("signals")))), ",").alias("signals"),
    )
    return {
        "outcomes": rows.groupBy("outcome").agg(F.count("*").alias("n")),
        "signals": rows.select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n")),
        "buckets": buckets,
    }


def _running_medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in the order of run and seq, with `median` and `earlier` of the positive rates before each row.

    The lower half of a run's rates is a heap with its largest on top, the upper half one with its smallest."""
    low: list[float] = []
    high: list[float] = []
    run: object = low  # no run is this
    for batch in batches:
        medians, earlier = [], []
        for now, rate in zip(batch.column("run").to_pylist(), batch.column("rate").to_pylist()):
            if now != run:
                run, low, high = now, [], []
            n = len(low) + len(high)
            medians.append(None if not n else -low[0] if n % 2 else (high[0] - low[0]) / 2)
            earlier.append(n)
            if rate is not None and rate > 0:
                heappush(high, -heappushpop(low, -rate))
                if len(high) > len(low):
                    heappush(low, -heappop(high))
        yield batch.append_column("median", pa.array(medians, pa.float64())).append_column("earlier", pa.array(earlier, pa.int32()))


def throughput_drops(chunks: DataFrame, least: int = 3, share: float = 0.3, min_ms: float = 200.0) -> DataFrame:
    """chunks (run, seq, rate, ms) with `median` of the earlier positive rates of the run, `earlier` (how many) and `drop`.

    A run's rows pass one task in their order, in batches; a row costs the logarithm of the run's length, and what is
    held of a run are its rates."""
    kinds = StructType([*chunks.schema.fields, StructField("median", DoubleType()), StructField("earlier", IntegerType())])
    rows = chunks.repartition("run").sortWithinPartitions("run", "seq", "rate").withColumn("rate", F.col("rate").cast("double"))
    marked = rows.mapInArrow(_running_medians, StructType([StructField(f.name, DoubleType()) if f.name == "rate" else f for f in kinds]))
    return marked.withColumn("drop", F.coalesce((F.col("earlier") >= least) & (F.col("ms") >= min_ms) & (F.col("rate") <= share * F.col("median")), F.lit(False)))


def diagnostic_alerts(counters: DataFrame, limits: dict[str, int]) -> DataFrame:
    """counters (one row) with `alerts`: the names of the counters that reach their limits."""
    return counters.withColumn("alerts", F.array_compact(F.array(*[F.when(F.col(c) >= n, F.lit(c)) for c, n in limits.items()])))


def evaluate(questions: DataFrame, results: DataFrame) -> DataFrame:
    """question_id, recall, precision, first_ok, passed per question.

    questions: question_id, category, expected (array), preferred_first; results: question_id, id, rank.
    A question passes if all expected ids are found and the preferred one, if any, comes first."""
    found = results.groupBy("question_id").agg(F.collect_set("id").alias("found"), F.count("*").alias("n_results"), F.min_by("id", "rank").alias("first"))
    met = questions.join(found, "question_id", "left")
    hits = F.coalesce(F.size(F.array_intersect("expected", F.coalesce("found", F.array().cast("array<string>")))), F.lit(0))
    first_ok = F.col("preferred_first").isNull() | F.coalesce(F.col("first") == F.col("preferred_first"), F.lit(False))
    scored = met.select("question_id", "category", hits.alias("hits"), F.size("expected").alias("n_expected"), F.coalesce("n_results", F.lit(0)).alias("n_results"), first_ok.alias("first_ok"))
    return scored.select(
        "question_id", "category", "first_ok",
        F.when(F.col("n_expected") > 0, F.col("hits") / F.col("n_expected")).alias("recall"),
        F.when(F.col("n_results") > 0, F.col("hits") / F.col("n_results")).alias("precision"),
        ((F.col("hits") == F.col("n_expected")) & F.col("first_ok")).alias("passed"),
    )


def evaluation_report(scored: DataFrame) -> DataFrame:
    """category (null: all), questions, passed, recall, precision, over all questions of the category."""
    return scored.rollup("category").agg(
        F.count("*").alias("questions"), F.count_if("passed").alias("passed"),
        F.round(F.avg(F.coalesce("recall", F.lit(0.0))), 6).alias("recall"), F.round(F.avg(F.coalesce("precision", F.lit(0.0))), 6).alias("precision"),
    )


def compare_evaluations(base: DataFrame, other: DataFrame) -> DataFrame:
    """question_id, change, recall_delta, precision_delta of two evaluations of the same questions."""
    a = base.select("question_id", F.col("passed").alias("p0"), F.coalesce("recall", F.lit(0.0)).alias("r0"), F.coalesce("precision", F.lit(0.0)).alias("q0"))
    b = other.select("question_id", F.col("passed").alias("p1"), F.coalesce("recall", F.lit(0.0)).alias("r1"), F.coalesce("precision", F.lit(0.0)).alias("q1"))
    change = F.when(F.col("p1") & ~F.col("p0"), "improved").when(F.col("p0") & ~F.col("p1"), "regressed").when(F.col("r1") > F.col("r0"), "improved").when(F.col("r1") < F.col("r0"), "regressed").otherwise("same")
    return a.join(b, "question_id").select("question_id", change.alias("change"), F.round(F.col("r1") - F.col("r0"), 9).alias("recall_delta"), F.round(F.col("q1") - F.col("q0"), 9).alias("precision_delta"))


def extraction_scores(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """doc, n_expected, n_found, n_hit, precision, recall, f1 of two sets of rows (doc and keys)."""
    e, f = expected.select("doc", *keys).distinct(), found.select("doc", *keys).distinct()
    both = e.withColumn("e", F.lit(1)).join(f.withColumn("f", F.lit(1)), ["doc", *keys], "full_outer")
    sums = both.groupBy("doc").agg(F.count("e").alias("n_expected"), F.count("f").alias("n_found"), F.count(F.col("e") + F.col("f")).alias("n_hit"))
    p, r = F.try_divide("n_hit", "n_found"), F.try_divide("n_hit", "n_expected")
    return sums.withColumn("precision", F.coalesce(p, F.lit(0.0))).withColumn("recall", F.coalesce(r, F.lit(0.0))).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def overall_extraction_score() -> Column:
    """0.3 F1 + 0.4 temporal recall + 0.2 coverage + 0.1 (1 - self-reference penalty)."""
    return 0.3 * F.col("f1") + 0.4 * F.col("temporal_recall") + 0.2 * F.col("coverage") + 0.1 * (1 - F.col("self_reference"))


def count_upsert(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """relation_type, source_name, target_name, count, first_seen, last_seen: seen (with ts) added to the existing counters."""
    keys = ["relation_type", "source_name", "target_name"]
    new = seen.groupBy(*keys).agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    both = existing.select(*keys, "count", "first_seen", "last_seen").unionByName(new)
    return both.groupBy(*keys).agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
