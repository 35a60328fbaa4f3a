"""Named queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemosia.functions import edtf, text
from mnemosia.operators import aggregates, duplicates, facts, graph as g, ingest, listing, rank, recall, salience, search, service, upsert
from mnemosia.operators.graph import kept
from mnemosia.sources import files
from mnemosia.streaming import feed

from .graph import ALIASES_SQL, AS_OF, EDGES_SQL, NODES_SQL, SALIENCE_SQL, SCORED_SQL, aliases, edges, nodes, table, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "hybrid_search"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return salience.with_salience(nodes(spark, d), AS_OF)


WITH_SCORED = f"WITH {NODES_SQL}, {SCORED_SQL}"
WITH_EDGES = f"WITH {EDGES_SQL}"
WITH_ALL = f"WITH {NODES_SQL}, {SCORED_SQL}, {EDGES_SQL}, {ALIASES_SQL}"

# --- listings ----------------------------------------------------------------


@query(f"{WITH_SCORED} SELECT id, label, salience_score, (SELECT count(*) > 70 FROM scored WHERE type = 'customer' AND salience_score >= 1.5) AS has_more FROM scored WHERE type = 'customer' AND salience_score >= 1.5 ORDER BY salience_score DESC, updated_at DESC, id LIMIT 50 OFFSET 20")
def list_nodes(spark, d):
    return listing.list_nodes(_scored(spark, d), "customer", 1.5, 50, 20).select("id", "label", "salience_score", "has_more")


@query(f"{WITH_EDGES} SELECT source, target, weight, (SELECT count(*) > 100 FROM edges WHERE relation = 'uses' AND date_lower <= DATE '1996-06-15' AND date_upper >= DATE '1996-06-15') AS has_more FROM edges WHERE relation = 'uses' AND (date_lower IS NULL OR date_lower <= DATE '1996-06-15') AND (date_upper IS NULL OR date_upper >= DATE '1996-06-15') ORDER BY source, target, relation LIMIT 100")
def list_edges_active(spark, d):
    return listing.list_edges(edges(spark, d), limit=100, relation="uses", active="1996-06-15").select("source", "target", "weight", "has_more")


@query(f"{WITH_EDGES} SELECT relation, count(*) AS n FROM edges WHERE is_current = false GROUP BY relation")
def edges_not_current(spark, d):
    return listing.filter_edges(edges(spark, d), current=False).groupBy("relation").agg(F.count("*").alias("n"))


@query(f"{WITH_SCORED} SELECT id, type, label, properties, access_count, salience_score FROM scored WHERE id = 'customer:7'")
def get_node(spark, d):
    return listing.get(_scored(spark, d), id="customer:7").select("id", "type", "label", "properties", "access_count", "salience_score")


@query(
    f"""{WITH_ALL}, q(label) AS (SELECT n_name FROM nation UNION SELECT 'cust 3' UNION SELECT 'CUST   5' UNION SELECT 'no such thing' UNION SELECT lower(p_brand) || ' 7' FROM part),
    t AS (SELECT q.label, id, 1 AS r FROM q JOIN nodes n ON lower(n.label) = lower(q.label)
      UNION ALL SELECT q.label, node_id, 2 FROM q JOIN aliases a ON lower(a.alias) = lower(q.label)
      UNION ALL SELECT q.label, node_id, 3 FROM q JOIN aliases a ON a.normalized_alias = regexp_replace(lower(trim(q.label)), '\\s+', ' ', 'g')),
    b AS (SELECT label, min(r) AS r FROM t GROUP BY 1)
    SELECT t.label, min(id) AS id, b.r AS match_rank FROM t JOIN b USING (label, r) GROUP BY t.label, b.r HAVING count(DISTINCT id) = 1"""
)
def node_by_label(spark, d):
    labels = table(spark, d, "nation").selectExpr("n_name AS label").union(table(spark, d, "part").selectExpr("concat(lower(p_brand), ' 7')"))
    labels = labels.union(spark.createDataFrame([("cust 3",), ("CUST   5",), ("no such thing",)], "label string"))
    return listing.node_by_label(nodes(spark, d), aliases(spark, d), labels)


@query(f"WITH {ALIASES_SQL} SELECT node_id, alias, normalized_alias FROM aliases WHERE alias_type = 'brand' ORDER BY normalized_alias, node_id, alias LIMIT 40 OFFSET 10")
def list_aliases(spark, d):
    return listing.list_aliases(aliases(spark, d), kind="brand", limit=40, offset=10).select("node_id", "alias", "normalized_alias")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id AS id", "event_type AS action", "'user' AS entity_type", "CAST(user_id AS string) AS entity_id", "ts AS created_at", "props AS detail")


@query("SELECT event_id AS id, user_id::VARCHAR AS entity_id, ts AS created_at FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id DESC LIMIT 50")
def query_audit(spark, d):
    return listing.query_audit(_audit(spark, d), action="purchase", since="2024-01-05 00:00:00").select("id", "entity_id", "created_at")


@query("SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'purged' ELSE 'kept' END AS part, count(*) AS n FROM events GROUP BY 1")
def purge_audit(spark, d):
    kept, old = listing.purge_audit(_audit(spark, d), "2024-01-27 00:00:00", 7)
    return kept.select(F.lit("kept").alias("part")).union(old.select(F.lit("purged"))).groupBy("part").agg(F.count("*").alias("n"))


@query(f"{WITH_SCORED} SELECT id FROM nodes WHERE id IN (SELECT 'customer:' || (l_orderkey % 400) FROM lineitem)")
def existing_ids(spark, d):
    ids = table(spark, d, "lineitem").selectExpr("concat('customer:', l_orderkey % 400) AS id")
    return listing.existing_ids(nodes(spark, d), ids)


@query(f"WITH {EDGES_SQL} SELECT DISTINCT relation AS name FROM edges UNION ALL SELECT DISTINCT 'own_' || event_type FROM events WHERE user_id = 5")
def relation_types(spark, d):
    """The graph's relations for all tenants, and what one tenant's own events are called."""
    own = table(spark, d, "events").selectExpr("concat('own_', event_type) AS name", "CAST(user_id AS string) AS tenant_id")
    every = edges(spark, d).select(F.col("relation").alias("name"), F.lit(None).cast("string").alias("tenant_id")).unionByName(own)
    return listing.relation_types(every.distinct(), "5").select("name")


@query(f"{WITH_EDGES} SELECT relation, count(*) AS n FROM edges WHERE weight > 50 OR length(source) > 12 GROUP BY 1")
def edge_violations(spark, d):
    heavy = edges(spark, d).withColumn("weight", F.when((F.col("weight") > 50) | (F.length("source") > 12), 2000.0).otherwise(F.col("weight")))
    return heavy.where(F.size(listing.edge_violations()) > 0).groupBy("relation").agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars = 0 AS needs_search_text, doc_id % 3 = 0 AS needs_embedding FROM documents WHERE doc_id % 3 = 0 OR n_chars = 0 ORDER BY doc_id DESC LIMIT 100")
def maintenance_scan(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", "CAST(doc_id AS string) AS id", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE array(1.0F) END AS embedding", "CASE WHEN n_chars = 0 THEN '' ELSE 'x' END AS search_text", "'{}' AS properties", "CAST(NULL AS string) AS superseded_by", "doc_id AS updated_at", "doc_id AS created_at")
    return listing.maintenance_scan(docs).select("doc_id", "needs_search_text", "needs_embedding")


# --- salience, statistics ------------------------------------------------------


@query(f"{WITH_SCORED} SELECT id, salience_score FROM scored WHERE type IN ('customer', 'supplier')")
def salience_scores(spark, d):
    return _scored(spark, d).where(F.col("type").isin("customer", "supplier")).select("id", "salience_score")


@query(f"{WITH_SCORED} SELECT type, count(*) AS n, count(*) FILTER (abs(salience_score - round({'1.0'}, 6)) > 1e-9) AS changed FROM scored GROUP BY type")
def recalculate_salience(spark, d):
    rows = nodes(spark, d).withColumn("salience_score", F.lit(1.0))
    new = salience.recalculate(rows, AS_OF).withColumn("changed", F.abs(F.round("salience_score", 6) - 1.0) > 1e-9)
    return new.groupBy("type").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query(f"{WITH_ALL} SELECT count(*) AS nodes, count(DISTINCT type) AS entity_types, 0::BIGINT AS embedded, floor(avg(salience_score) * 100 + 0.5) / 100 AS avg_salience, (SELECT count(*) FROM edges) AS edges FROM scored")
def graph_stats(spark, d):
    return aggregates.graph_stats(_scored(spark, d), edges(spark, d))


# --- search ------------------------------------------------------------------

_QUERIES_SQL = """bq AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2)) AS q FROM benchmark),
dl AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2)) AS l FROM documents),
dx AS (SELECT doc_id, len(l) AS size, unnest(l) AS lexeme FROM dl), qx AS (SELECT query_id, len(q) AS need, unnest(q) AS lexeme FROM bq),
hits AS (SELECT query_id, doc_id, max(need)::DOUBLE / max(size) AS match FROM dx JOIN qx USING (lexeme) GROUP BY 1, 2 HAVING count(*) = max(need)),
ranked AS (SELECT query_id, doc_id, round(match * 0.8 + least(1.0 / 100.0, 1.0) * 0.2, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(match * 0.8 + least(1.0 / 100.0, 1.0) * 0.2, 9) DESC, lpad(doc_id::VARCHAR, 12, '0')) AS rank FROM hits)"""


def _doc_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("lpad(CAST(doc_id AS string), 12, '0') AS id", "doc_id", "'document' AS type", "text AS search_text", "1.0D AS salience_score", "1 AS updated_at")


def _bench_queries(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) >= 2)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"))


@query(f"WITH {_QUERIES_SQL} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 20")
def full_text_search(spark, d):
    rows = _doc_nodes(spark, d)
    found = search.full_text(rows, None, _bench_queries(spark, d), limit=20, stemmed=False)
    return found.select("query_id", F.col("id").cast("long").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lpad(vec_id::VARCHAR, 9, '0')) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10"""
)
def semantic_search(spark, d):
    v = table(spark, d, "embeddings").selectExpr("lpad(CAST(vec_id AS string), 9, '0') AS id", "vec_id", "embedding")
    asked = v.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding")
    return search.semantic(v, asked).select("query_id", F.col("id").cast("long").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


_HYBRID_SQL = f"""WITH {NODES_SQL}, {SCORED_SQL}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT s.*, e.vec_id, e.e FROM scored s JOIN v e ON s.id = 'customer:' || e.vec_id),
l AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(label || chr(10) || type || chr(10) || json_extract_string(properties, '$.nation_id') || chr(10) || json_extract_string(properties, '$.segment') || chr(10) || 'nation_id nation id segment'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2)) AS words FROM scored WHERE type = 'customer'),
seg AS (SELECT DISTINCT c_mktsegment AS m FROM customer),
q AS (SELECT m AS query_id, (SELECT e FROM v WHERE vec_id = length(m)) AS qe FROM seg),
t AS (SELECT q.query_id, id, row_number() OVER (PARTITION BY q.query_id ORDER BY round(0.8::DOUBLE / len(words) + 0.2 * least(salience_score / 100.0, 1.0), 9) DESC, salience_score DESC, updated_at DESC, id) AS rank
  FROM q JOIN l ON list_contains(l.words, lower(q.query_id)) JOIN scored USING (id)),
n AS (SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(c.e, q.qe) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(q.qe, q.qe))), 6) DESC, id) AS rank FROM q, c),
f AS (SELECT coalesce(t.query_id, n.query_id) AS query_id, coalesce(t.id, n.id) AS id, coalesce(1.0::DOUBLE / (60 + t.rank), 0) + coalesce(1.0::DOUBLE / (60 + n.rank), 0) AS rrf
  FROM (SELECT * FROM t WHERE rank <= 10) t FULL JOIN (SELECT * FROM n WHERE rank <= 10) n ON t.query_id = n.query_id AND t.id = n.id),
s AS (SELECT f.*, round(rrf * 0.85 + least(salience_score / 100.0, 1.0) * 0.15, 9) AS score, salience_score, updated_at FROM f JOIN scored USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, salience_score DESC, updated_at DESC, id) AS rank FROM s)
SELECT query_id, id, round(rrf, 6) AS rrf, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


@query(_HYBRID_SQL)
def hybrid_search(spark, d):
    """Market segments as queries: customers whose text names them, and those near a vector."""
    v = vectors(spark, d)
    c = kept(_scored(spark, d).where(F.col("type") == "customer").select("id", "type", "label", "properties", "salience_score", "updated_at"))
    segments = table(spark, d, "customer").select(F.col("c_mktsegment").alias("query_id")).distinct()
    asked = segments.join(v.select(F.col("vec_id"), "embedding"), F.length("query_id") == F.col("vec_id")).select("query_id", "embedding")
    written = c.withColumn("search_text", text.search_text(F.col("label"), F.col("type"), F.col("properties")))
    words = search.full_text(written, None, segments.withColumn("text", F.col("query_id")), limit=10, stemmed=False)
    near = search.semantic(v.select("id", "embedding").join(c.select("id"), "id", "left_semi"), asked, 10)
    found = search.hybrid(words, near, c)
    return found.select("query_id", "id", F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_QUERIES_SQL}, c AS (SELECT * FROM ranked WHERE rank <= 20), b AS (SELECT doc_id, quality, toxic FROM labels),
    s AS (SELECT c.query_id, c.doc_id, least(greatest(0.35 / c.rank + coalesce(CASE WHEN quality = 1 THEN 0.32 WHEN quality = 0 THEN -0.18 END + least(1 + toxic, 4) * 0.05 + 0.5 * 0.08 + CASE WHEN toxic = 0 THEN 0.08 ELSE 0.0 END + 0.08, 0.0), -0.8), 0.8) AS belief FROM c LEFT JOIN b USING (doc_id))
    SELECT query_id, doc_id, round(belief, 6) AS belief FROM s"""
)
def belief_aware_ranking(spark, d):
    found = search.full_text(_doc_nodes(spark, d), None, _bench_queries(spark, d), limit=20, stemmed=False)
    beliefs = table(spark, d, "labels").selectExpr("lpad(CAST(doc_id AS string), 12, '0') AS id", "CASE WHEN quality = 1 THEN 'supported' ELSE 'contested' END AS status", "1 + toxic AS evidence_count", "0.5D AS preferred_confidence", "toxic = 0 AS matches_current", "timestamp_ntz'2024-01-01 00:00:00' AS last_observed")
    return rank.belief_score(found, beliefs).select("query_id", F.col("id").cast("long").alias("doc_id"), F.round("belief", 6).alias("belief"))


@query(
    f"""{WITH_SCORED}, c AS (SELECT *, row_number() OVER (ORDER BY salience_score DESC, id) AS rank FROM scored WHERE type = 'customer' QUALIFY rank <= 50),
    w AS (SELECT *, epoch(updated_at) AS a, min(epoch(updated_at)) OVER () AS lo, max(epoch(updated_at)) OVER () AS hi FROM c),
    p AS (SELECT *, least(greatest((a - lo) / nullif(hi - lo, 0), 0.0), 1.0) AS pos, greatest(-0.2, list_max(list_transform([year(updated_at), year(created_at), 1990 + id[-1:]::INT], lambda y: CASE abs(y - 1995) WHEN 0 THEN 0.45 WHEN 1 THEN 0.18 WHEN 2 THEN 0.08 WHEN 3 THEN 0.08 ELSE -least(abs(y - 1995) / 20.0, 0.2) END))) AS ys FROM w)
    SELECT id, round(least(greatest(0.08 / rank + (1 - pos) * 0.35 + ys, -0.9), 0.9), 6) AS temporal FROM p"""
)
def temporal_ranking(spark, d):
    c = _scored(spark, d).where(F.col("type") == "customer").withColumn("query_id", F.lit(1)).withColumn("search_text", F.concat(F.lit("since 199"), F.substring("id", -1, 1), F.lit(", not 12000")))
    c = search.top(c, 50, F.desc("salience_score"), F.asc("id"))
    return rank.temporal_score(c, "history of deliveries in 1995").select("id", F.round("temporal", 6).alias("temporal"))


_TERMS = ["customer", "00", "building"]
_TERMS_SQL = " + ".join(f"CASE WHEN contains(lower(trim(label)), '{t}') THEN 3.2 WHEN contains(lower(properties), '{t}') THEN 1.8 ELSE 0 END" for t in _TERMS)
_MATCHED_SQL = " + ".join(f"(contains(lower(trim(label)), '{t}') OR contains(lower(properties), '{t}'))::INT" for t in _TERMS)


@query(
    f"""{WITH_SCORED}, c AS (SELECT *, row_number() OVER (ORDER BY salience_score DESC, id) AS rank FROM scored WHERE type = 'customer' QUALIFY rank <= 50),
    w AS (SELECT *, greatest(0, (epoch(max(updated_at) OVER ()) - epoch(updated_at)) / 86400.0) AS age FROM c),
    b AS (SELECT *, least(greatest(0.35 / rank + CASE WHEN user_boosted THEN 0.32 ELSE -0.18 END + least(access_count, 4) * 0.05 + 0.5 * 0.08 + CASE WHEN access_count % 2 = 0 THEN 0.08 ELSE 0.0 END + greatest(0, 1 - age / 365.0) * 0.08, -0.8), 0.8) AS belief FROM w),
    s AS (SELECT id, salience_score, updated_at, round({_TERMS_SQL} + ({_MATCHED_SQL}) / 3.0 * 4.2 + CASE WHEN lower(trim(label)) = 'customer 00 building' THEN 10 ELSE 0 END + CASE WHEN contains(lower(label), 'customer 00 building') THEN 4 ELSE 0 END
      + CASE WHEN user_boosted THEN 0.3 ELSE 0.0 END + least(salience_score / 140, 1.0) + 0.8 / rank + belief, 9) AS score FROM b)
    SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, salience_score DESC, updated_at DESC, id) AS new_rank FROM s QUALIFY new_rank <= 10"""
)
def prototype_rerank(spark, d):
    """The most salient customers by a query's terms in label and text, and what is believed of them."""
    c = _scored(spark, d).where(F.col("type") == "customer").withColumn("query_id", F.lit(1)).withColumn("search_text", F.col("properties"))
    c = search.top(c, 50, F.desc("salience_score"), F.asc("id"))
    beliefs = c.selectExpr("id", "CASE WHEN user_boosted THEN 'supported' ELSE 'contested' END AS status", "access_count AS evidence_count", "0.5D AS preferred_confidence", "access_count % 2 = 0 AS matches_current", "updated_at AS last_observed")
    found = rank.prototype_rerank(c, beliefs, "Customer 00 Building", "term_focus", 10)
    return found.select("id", F.round("score", 6).alias("score"), F.col("new_rank").cast("long").alias("new_rank"))


@query(
    f"""{WITH_ALL}, seeds AS (SELECT id, row_number() OVER (ORDER BY salience_score DESC, id) AS rank FROM scored WHERE type = 'customer' QUALIFY rank <= 5),
    e AS (SELECT source AS seed, target AS other, row_number() OVER (PARTITION BY source ORDER BY source, target, relation) AS n FROM edges WHERE source IN (SELECT id FROM seeds)
      UNION ALL SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY source, target, relation) FROM edges WHERE target IN (SELECT id FROM seeds)),
    x AS (SELECT DISTINCT other AS id FROM e WHERE n <= 3 AND other <> seed AND other NOT IN (SELECT id FROM seeds)),
    u AS (SELECT id, 0 AS src, rank AS place, NULL::DOUBLE AS s, NULL::TIMESTAMP AS t FROM seeds UNION ALL SELECT x.id, 1, 0, salience_score, updated_at FROM x JOIN scored USING (id))
    SELECT id, src, row_number() OVER (ORDER BY src, place, s DESC, t DESC, id) AS rank FROM u QUALIFY rank <= 15"""
)
def graph_expansion(spark, d):
    n = _scored(spark, d)
    c = n.where(F.col("type") == "customer").withColumn("query_id", F.lit(1))
    seeds = search.top(c, 5, F.desc("salience_score"), F.asc("id")).select("query_id", "id", "rank")
    extra = rank.expansion(edges(spark, d), seeds.select("query_id", "id")).join(n.select("id", "salience_score", "updated_at"), "id")
    return rank.merge_expanded(seeds, extra, 15).select("id", F.col("src"), F.col("rank").cast("long").alias("rank"))


@query(
    """WITH h AS (SELECT user_id AS query_id, event_type AS source, (event_id % 97)::VARCHAR AS key, value AS score FROM events),
    s AS (SELECT query_id, source, key, score * CASE source WHEN 'click' THEN 0.5 WHEN 'purchase' THEN 2.0 ELSE 1.0 END + CASE WHEN source = 'view' THEN 5.0 ELSE 0.0 END AS score FROM h),
    b AS (SELECT query_id, key, max({'score': score, 'source': source}) AS b FROM s GROUP BY 1, 2),
    r AS (SELECT query_id, key, b.source AS source, round(b.score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(b.score, 9) DESC, key) AS rank FROM b) SELECT * FROM r WHERE rank <= 3"""
)
def merged_results(spark, d):
    hits = table(spark, d, "events").selectExpr("user_id AS query_id", "'general' AS intent", "event_type AS source", "CAST(event_id % 97 AS string) AS key", "value AS score")
    found = rank.merge_results(hits, {"click": 0.5, "purchase": 2.0}, {("general", "view"): 5.0}, limit=3)
    return found.select("query_id", "key", "source", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    """SELECT item_id, CASE WHEN contains(q, 'when ') OR contains(q, 'what happened') OR contains(q, 'history') OR contains(q, 'timeline') OR contains(q, 'before ') OR contains(q, 'after ') OR contains(q, 'during ') OR contains(q, 'current') THEN 'temporal'
      WHEN contains(q, 'related') OR contains(q, 'relationship') OR contains(q, 'connected') OR contains(q, 'path') OR contains(q, 'between') OR contains(q, 'with') OR contains(q, 'who knows') THEN 'relationship'
      WHEN contains(q, 'how ') OR contains(q, 'policy') OR contains(q, 'rule') OR contains(q, 'preference') OR contains(q, 'stance') OR contains(q, 'approach') THEN 'procedural'
      WHEN contains(q, 'who is') OR contains(q, 'what is') OR contains(q, 'tell me about') THEN 'entity' ELSE 'general' END AS intent FROM (SELECT item_id, lower(trim(text)) AS q FROM benchmark)"""
)
def query_intents(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.intent_of(F.col("text")).alias("intent"))


# --- graph -------------------------------------------------------------------


@query(f"{WITH_EDGES}, e AS ((SELECT * FROM edges WHERE source = 'nation:3' ORDER BY source, target, relation LIMIT 30) UNION ALL (SELECT * FROM edges WHERE target = 'nation:3' ORDER BY source, target, relation LIMIT 30)) SELECT source, target, relation FROM e")
def neighbor_edges(spark, d):
    return g.neighbor_edges(edges(spark, d), "nation:3", 30).select("source", "target", "relation")


@query(f"{WITH_EDGES}, e AS (SELECT target AS id FROM edges WHERE source = 'customer:1' UNION SELECT source FROM edges WHERE target = 'customer:1') SELECT id FROM e WHERE id <> 'customer:1' ORDER BY id LIMIT 1000")
def neighbors(spark, d):
    return g.neighbors(nodes(spark, d), edges(spark, d), "customer:1")[0].select("id")


@query(
    f"""{WITH_EDGES}, p AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
    l1 AS (SELECT DISTINCT b AS id FROM p WHERE a = 'customer:1'), l2 AS (SELECT DISTINCT b AS id FROM p WHERE a IN (SELECT id FROM l1)),
    n AS (SELECT 'customer:1' AS id, 0 AS hop UNION SELECT id, 1 FROM l1 WHERE id <> 'customer:1' UNION SELECT id, 2 FROM l2 WHERE id <> 'customer:1' AND id NOT IN (SELECT id FROM l1)) SELECT id, hop FROM n"""
)
def traverse(spark, d):
    return g.traverse_levels(edges(spark, d), ["customer:1"], 2, cap=None).select(F.col("node").alias("id"), "hop")


@query(
    f"""{WITH_ALL}, p AS (SELECT source AS node, target AS other, source, target, 0 AS backward FROM edges UNION SELECT target, source, source, target, 1 FROM edges),
    s0 AS (SELECT 'nation:3' AS id), """
    + ", ".join(
        f"""f{k} AS (SELECT other AS id, min({{'s': source, 't': target, 'b': backward}}) AS found FROM p WHERE node IN (SELECT id FROM {"s0" if k == 1 else f"l{k - 1}"}) AND other NOT IN (SELECT id FROM s{k - 1}) GROUP BY 1),
    l{k} AS (SELECT id FROM f{k} ORDER BY found LIMIT (SELECT 500 - count(*) FROM s{k - 1})), s{k} AS (SELECT id FROM s{k - 1} UNION ALL SELECT id FROM l{k})"""
        for k in (1, 2, 3)
    )
    + " SELECT id, type FROM s3 JOIN nodes USING (id)"
)
def traverse_capped(spark, d):
    return g.traverse(nodes(spark, d), edges(spark, d), "nation:3", 3)[0].select("id", "type")


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, p AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
    r(id, hop) AS (SELECT 'customer:1', 0::BIGINT UNION SELECT p.b, hop + 1 FROM r JOIN p ON r.id = p.a WHERE hop < 3)
    SELECT min(hop) AS n_edges FROM r WHERE id = (SELECT 'region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1)"""
)
def shortest_path(spark, d):
    """From a customer to its region: by way of the nation."""
    end = table(spark, d, "customer").where("c_custkey = 1").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("concat('region:', n_regionkey) AS r").first().r
    return g.shortest_path(nodes(spark, d), edges(spark, d), "customer:1", end).agg((F.max("place")).cast("long").alias("n_edges"))


@query(f"{WITH_EDGES}, a AS (SELECT target AS node, 1 AS hop FROM edges WHERE source = 'customer:2'), b AS (SELECT DISTINCT e.target AS node, 2 AS hop FROM a JOIN edges e ON e.source = a.node), c AS (SELECT DISTINCT e.target AS node, 3 AS hop FROM b JOIN edges e ON e.source = b.node) SELECT node, min(hop) AS hop FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY node")
def reachable_nodes(spark, d):
    return g.reachable(edges(spark, d), "customer:2", 3)


@query(f"{WITH_EDGES}, d AS (SELECT source AS id, target AS other, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, source, 0, 1 FROM edges) SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, count(DISTINCT other) AS n_neighbors FROM d GROUP BY id")
def node_degrees(spark, d):
    return g.degrees(edges(spark, d))


@query(f"{WITH_ALL} SELECT (SELECT count(*) FROM nodes WHERE id <> 'customer:1') AS n_nodes, (SELECT count(*) FROM edges WHERE source <> 'customer:1' AND target <> 'customer:1') AS n_edges")
def delete_node(spark, d):
    n, e = g.delete_node(nodes(spark, d), edges(spark, d), "customer:1")
    return n.agg(F.count("*").alias("n_nodes")).join(F.broadcast(e.agg(F.count("*").alias("n_edges"))))


@query(f"{WITH_EDGES} SELECT CASE WHEN source = 'nation:3' THEN 'nation:new' ELSE source END AS source, CASE WHEN target = 'nation:3' THEN 'nation:new' ELSE target END AS target, relation FROM edges WHERE source = 'nation:3' OR target = 'nation:3'")
def migrate_node(spark, d):
    _, e = g.migrate_node(nodes(spark, d), edges(spark, d), "nation:3", "nation:new", True)
    return e.where("source = 'nation:new' OR target = 'nation:new'").select("source", "target", "relation")


# --- facts -------------------------------------------------------------------

_EVIDENCE_SQL = "ev AS (SELECT user_id AS node_id, event_type AS property, floor(value / 50)::BIGINT::VARCHAR AS value, 'src' || (event_id % 3) AS source, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, (event_id % 10) / 10.0 AS confidence FROM events)"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id AS node_id", "event_type AS property", "CAST(CAST(floor(value / 50) AS bigint) AS string) AS value", "concat('src', event_id % 3) AS source", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS ts", "CAST(event_id % 10 AS double) / 10 AS confidence", "event_id")


def _current(ev: DataFrame) -> DataFrame:
    return ev.where("node_id % 4 <> 0").groupBy("node_id", "property").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


_CURRENT_SQL = "cur AS (SELECT user_id AS node_id, event_type AS property, arg_max(floor(value / 50)::BIGINT::VARCHAR, {'t': ts, 'i': event_id}) AS value FROM events WHERE user_id % 4 <> 0 GROUP BY 1, 2)"


@query(
    f"""WITH {_EVIDENCE_SQL}, {_CURRENT_SQL},
    c AS (SELECT node_id, property, value, avg(confidence) AS confidence, count(*) AS n, max(ts) AS last FROM ev GROUP BY 1, 2, 3),
    o AS (SELECT c.*, cur.value IS NOT NULL AS has, coalesce(c.value = cur.value, false) AS is_cur, row_number() OVER (PARTITION BY c.node_id, c.property ORDER BY round(confidence, 12) DESC, n DESC, coalesce(c.value = cur.value, false) DESC, last DESC, c.value) AS rn FROM c LEFT JOIN cur USING (node_id, property)),
    s AS (SELECT *, max(CASE WHEN is_cur THEN rn END) OVER (PARTITION BY node_id, property) AS sw FROM o),
    p AS (SELECT *, CASE WHEN sw IS NULL OR (rn <> 1 AND rn <> sw) THEN rn WHEN rn = sw THEN 1 ELSE sw END AS place FROM s),
    b AS (SELECT node_id, property, max(CASE WHEN place = 1 THEN value END) AS preferred_value, max(CASE WHEN place = 1 THEN confidence END) AS pc, max(CASE WHEN place = 2 THEN confidence END) AS rc, sum(n)::BIGINT AS evidence_count, count(*) AS n_claims, bool_or(has) AS has FROM p GROUP BY 1, 2)
    SELECT node_id, property, preferred_value, round(pc, 9) AS preferred_confidence, evidence_count, n_claims, CASE WHEN has AND rc IS NOT NULL AND pc - rc < 0.15 THEN 'contested' WHEN NOT has THEN 'superseded' ELSE 'supported' END AS status FROM b"""
)
def fact_beliefs(spark, d):
    ev = _evidence(spark, d)
    return facts.beliefs(ev, _current(ev))


@query(
    f"""WITH {_CURRENT_SQL}, up AS (SELECT user_id AS node_id, event_type AS property, floor(value / 50)::BIGINT::VARCHAR AS value FROM events WHERE event_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)
    SELECT up.node_id, up.property, up.value, coalesce(cur.value <> up.value, false) AS conflicts, CASE WHEN cur.value <> up.value THEN cur.value END AS previous_value FROM up LEFT JOIN cur USING (node_id, property)"""
)
def fact_consolidation(spark, d):
    ev = _evidence(spark, d)
    w = Window.partitionBy("node_id", "property").orderBy("event_id")
    updates = ev.where("event_id % 20 = 0").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "event_id")
    _, new = facts.consolidate(_current(ev), updates)
    return new.select("node_id", "property", "value", F.col("conflicts_with_prior").alias("conflicts"), "previous_value")


@query(
    """WITH o AS (SELECT user_id AS n, event_type AS p, min(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2), w AS (SELECT user_id AS n, event_type AS p, min(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2)
    SELECT coalesce(o.n, w.n) AS node_id, coalesce(o.p, w.p) AS property, o.v IS NULL AS added, w.v IS NULL AS removed FROM o FULL JOIN w ON o.n = w.n AND o.p = w.p WHERE o.v IS DISTINCT FROM w.v"""
)
def property_diff(spark, d):
    ev = table(spark, d, "events").selectExpr("user_id AS node_id", "event_type AS property", "value", "ts")
    least = lambda rows: rows.groupBy("node_id", "property").agg(F.min("value").alias("value"))
    diff = facts.property_diff(least(ev.where("ts < timestamp_ntz'2024-01-15 00:00:00'")), least(ev.where("ts >= timestamp_ntz'2024-01-15 00:00:00'")))
    return diff.select("node_id", "property", F.col("old_value").isNull().alias("added"), F.col("new_value").isNull().alias("removed"))


# --- duplicates, resolution ----------------------------------------------------

_PARTS_SQL = """pn AS (SELECT 'part:' || p_partkey AS id, p_type AS type, split_part(p_name, ' ', 1) AS label, 1.0 + p_size AS salience_score FROM part),
pa AS (SELECT 'part:' || p_partkey AS node_id, lower(trim(split_part(p_name, ' ', 2))) AS name FROM part),
nm AS (SELECT id, type, name, bool_or(is_label) AS is_label FROM (SELECT id, type, lower(trim(label)) AS name, true AS is_label FROM pn UNION ALL SELECT pn.id, pn.type, pa.name, false FROM pn JOIN pa ON pn.id = pa.node_id) WHERE name <> '' GROUP BY 1, 2, 3),
pr AS (SELECT a.id AS left_id, b.id AS right_id, list_sort(list(DISTINCT a.name)) AS names, bool_or(a.is_label AND b.is_label) AS same_label, bool_or(a.is_label <> b.is_label) AS label_alias FROM nm a JOIN nm b ON a.type = b.type AND a.name = b.name AND a.id < b.id GROUP BY 1, 2)"""


def _part_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    n = p.selectExpr("concat('part:', p_partkey) AS id", "p_type AS type", "split_part(p_name, ' ', 1) AS label", "CAST(1.0 + p_size AS double) AS salience_score", "CAST(NULL AS string) AS superseded_by", "concat('{\"brand_id\":\"', p_brand, '\",\"size\":\"', p_size, '\"}') AS properties")
    return n, p.selectExpr("concat('part:', p_partkey) AS node_id", "lower(trim(split_part(p_name, ' ', 2))) AS normalized_alias")


@query(
    f"""WITH {_PARTS_SQL}, k AS (SELECT id, min(id) OVER (PARTITION BY type, names) AS class_id, count(*) OVER (PARTITION BY type, names) AS size FROM (SELECT id, type, list_sort(list({{'n': name, 'l': is_label}})) AS names FROM nm GROUP BY 1, 2))
    SELECT least(a.class_id, b.class_id) AS left_class, greatest(a.class_id, b.class_id) AS right_class, array_to_string(names, ',') AS shared_names, same_label, label_alias, count(*) AS n_pairs
    FROM pr JOIN k a ON a.id = left_id JOIN k b ON b.id = right_id GROUP BY ALL"""
)
def duplicate_pairs(spark, d):
    """Every pair of nodes with a shared name, by classes of nodes with the same names."""
    n, a = _part_nodes(spark, d)
    return duplicates.duplicate_classes(n, a)[1].withColumn("shared_names", F.array_join("shared_names", ",")).drop("salience")


@query(
    f"""WITH {_PARTS_SQL}, m0 AS (SELECT pr.*, l.salience_score AS ls, r.salience_score AS rs FROM pr JOIN pn l ON l.id = left_id JOIN pn r ON r.id = right_id ORDER BY same_label DESC, len(names) DESC, greatest(l.salience_score, r.salience_score) DESC, left_id, right_id LIMIT 300),
    m AS (SELECT m0.*, p1.p_brand = p2.p_brand AS ident FROM m0 JOIN part p1 ON 'part:' || p1.p_partkey = left_id JOIN part p2 ON 'part:' || p2.p_partkey = right_id),
    s AS (SELECT CASE WHEN rs > ls OR (rs = ls AND right_id < left_id) THEN right_id ELSE left_id END AS canonical_id, CASE WHEN rs > ls OR (rs = ls AND right_id < left_id) THEN left_id ELSE right_id END AS duplicate_id,
      round(least(CASE WHEN same_label THEN 0.55 ELSE 0 END + CASE WHEN label_alias THEN 0.2 ELSE 0 END + least(0.3, 0.15 + 0.05 * (len(names) - 1)) + CASE WHEN ident THEN 0.2 ELSE 0 END, 1.0)::DOUBLE, 2) AS score FROM m)
    SELECT * FROM s WHERE score >= 0.6 ORDER BY score DESC, canonical_id, duplicate_id LIMIT 100"""
)
def merge_suggestions(spark, d):
    """The best of three times as many candidate pairs as are shown."""
    n, a = _part_nodes(spark, d)
    return duplicates.merge_suggestions(n, duplicates.duplicate_pairs(n, a, limit=300), limit=100).drop("reasons")


# --- episodes and recall -------------------------------------------------------


def _episodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, d, "conversations")
    ep = c.groupBy("conv_id").agg(F.count("*").alias("n")).selectExpr("concat('ep:', conv_id) AS id", "concat('Conversation ', conv_id) AS title", "CASE WHEN n % 2 = 0 THEN 'open' ELSE 'closed' END AS status")
    ev = c.selectExpr(
        "concat('ev:', conv_id, ':', turn) AS id", "concat('ep:', conv_id) AS episode_id", "CASE turn % 4 WHEN 0 THEN 'message' WHEN 1 THEN 'decision' WHEN 2 THEN 'task' ELSE 'outcome' END AS kind", "substr(text, 1, 20) AS title",
        "CASE WHEN turn % 3 = 0 THEN '{\"status\":\"Pending\"}' ELSE '{}' END AS properties", "1.0D AS confidence",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(conv_id AS int), 0, CAST(turn AS int)) AS occurred_at", "CAST(NULL AS timestamp_ntz) AS occurred_start_at", "CAST(NULL AS timestamp_ntz) AS occurred_end_at", "timestamp_ntz'2024-01-01 00:00:00' AS created_at",
    )
    links = c.selectExpr("concat('ev:', conv_id, ':', turn) AS event_id", "concat('customer:', conv_id % 20) AS node_id", "role")
    return ev, links, ep


_EPISODES_SQL = """ev AS (SELECT 'ev:' || conv_id || ':' || turn AS id, 'ep:' || conv_id AS episode_id, CASE turn % 4 WHEN 0 THEN 'message' WHEN 1 THEN 'decision' WHEN 2 THEN 'task' ELSE 'outcome' END AS kind, turn % 3 = 0 AS pending,
  TIMESTAMP '2024-01-01' + to_days(conv_id::INTEGER) + to_minutes(turn) AS "at", 'customer:' || (conv_id % 20) AS node_id, role FROM conversations),
ep AS (SELECT 'ep:' || conv_id AS episode_id, count(*) % 2 = 0 AS is_open FROM conversations GROUP BY 1)"""


@query(f"""WITH {_EPISODES_SQL} SELECT id, kind, "at", node_id AS linked, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM ev WHERE node_id IN ('customer:1', 'customer:3') GROUP BY 1, 2, 3, 4""")
def event_contexts(spark, d):
    ev, links, ep = _episodes(spark, d)
    ids = spark.createDataFrame([("customer:1",), ("customer:3",), ("customer:3",)], "id string")
    found = recall.event_contexts(ev, links, ep, ids)
    return found.select("id", "kind", "at", F.array_join("linked_ids", ",").alias("linked"), F.array_join("roles", ",").alias("roles"))


@query(f"""WITH {_EPISODES_SQL}, c AS (SELECT DISTINCT ev.id, kind, "at", CASE WHEN pending THEN 'pending' WHEN is_open THEN 'open' END AS s FROM ev JOIN ep USING (episode_id) WHERE node_id = 'customer:1' AND kind IN ('decision', 'task')) SELECT id, kind, s AS open_status FROM c WHERE s IS NOT NULL ORDER BY "at" DESC, id LIMIT 10""")
def open_decisions(spark, d):
    ids = spark.createDataFrame([("customer:1",)], "id string")
    return recall.open_decisions(recall.event_contexts(*_episodes(spark, d), ids), 10).select("id", "kind", "open_status")


@query(f"""WITH {_EPISODES_SQL}, c AS (SELECT DISTINCT id, episode_id, kind, "at", pending FROM ev WHERE node_id = 'customer:1') SELECT episode_id AS key, count(*) AS n_events, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) FILTER (kind IN ('decision', 'task') AND pending) AS n_open, arg_max(id, {{'a': "at", 'i': id}}) AS latest_event FROM c GROUP BY 1 ORDER BY max("at") DESC, key LIMIT 10""")
def recent_episodes(spark, d):
    ids = spark.createDataFrame([("customer:1",)], "id string")
    found = recall.recent_episodes(recall.event_contexts(*_episodes(spark, d), ids), 10)
    return found.select("key", "n_events", F.array_join("kinds", ",").alias("kinds"), "n_open", "latest_event")


@query(
    f"""{WITH_ALL}, r(root) AS (VALUES ('nation:1'), ('nation:2')), n AS (SELECT source AS root, target AS id, relation, 'out' AS direction, weight FROM edges WHERE source IN (SELECT root FROM r) UNION ALL SELECT target, source, relation, 'in', weight FROM edges WHERE target IN (SELECT root FROM r))
    SELECT id, relation, direction, round(max(2 * salience_score + 3 + weight), 6) AS score FROM n JOIN scored USING (id) WHERE id NOT IN (SELECT root FROM r) GROUP BY 1, 2, 3 ORDER BY score DESC, id, relation, direction LIMIT 10"""
)
def recall_neighbors(spark, d):
    ids = spark.createDataFrame([("nation:1",), ("nation:2",)], "id string")
    return recall.recall_neighbors(edges(spark, d), _scored(spark, d), ids, 10).select("id", "relation", "direction", "score")


# --- feedback, evaluation, diagnostics -------------------------------------------


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").selectExpr(
        "event_id AS id", "concat('  Query ', user_id % 15, '  ') AS query_text", "CASE user_id % 2 WHEN 0 THEN 'text' ELSE 'hybrid' END AS search_mode", "CASE event_type WHEN 'view' THEN 'helpful' WHEN 'click' THEN 'unhelpful' ELSE 'missed' END AS outcome",
        "CASE WHEN event_id % 5 = 0 THEN CAST(array() AS array<string>) ELSE array(CAST(event_id % 3 AS string)) END AS retrieved", "array(CAST(event_id % 2 AS string)) AS selected", "array(CAST(event_id % 4 AS string)) AS expected", "ts AS created_at",
    )
    return ev.withColumn("signals", aggregates.retrieval_signals())


_FEEDBACK_SQL = """fb AS (SELECT event_id AS id, 'query ' || (user_id % 15) AS q, CASE user_id % 2 WHEN 0 THEN 'text' ELSE 'hybrid' END AS search_mode, CASE event_type WHEN 'view' THEN 'helpful' WHEN 'click' THEN 'unhelpful' ELSE 'missed' END AS outcome,
  event_id % 5 = 0 AS none, event_id % 3 = event_id % 2 AS sel, event_id % 3 = event_id % 4 AS exp, ts FROM events),
sg AS (SELECT *, list_filter([CASE WHEN outcome = 'helpful' AND NOT none AND sel THEN 'confirmed_recall' END, CASE WHEN none THEN 'empty_result' END, CASE WHEN outcome = 'unhelpful' AND NOT none THEN 'irrelevant_result' END, CASE WHEN outcome = 'missed' AND NOT (NOT none AND exp) THEN 'missed_known_item' END], lambda x: x IS NOT NULL) AS signals FROM fb)"""


@query(f"WITH {_FEEDBACK_SQL} SELECT signal, count(*) AS n FROM (SELECT unnest(signals) AS signal FROM sg) GROUP BY 1")
def feedback_signals(spark, d):
    return aggregates.feedback_summary(_feedback(spark, d))["signals"]


@query(f"WITH {_FEEDBACK_SQL} SELECT q AS normalized_query, search_mode, count(*) AS n, count(*) FILTER (outcome = 'helpful') AS helpful, count(*) FILTER (outcome = 'unhelpful') AS unhelpful, count(*) FILTER (outcome = 'missed') AS missed, max(ts) AS last_seen, array_to_string(list_sort(list_distinct(flatten(list(signals)))), ',') AS signals FROM sg GROUP BY 1, 2")
def feedback_buckets(spark, d):
    return aggregates.feedback_summary(_feedback(spark, d))["buckets"].drop("example")


@query(
    f"""WITH {_QUERIES_SQL}, res AS (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 10), ex AS (SELECT query_id, list(doc_id) AS expected, query_id % 3 AS category FROM ranked WHERE rank IN (1, 3, 15) GROUP BY 1),
    s AS (SELECT ex.query_id, category, len(expected) AS ne, (SELECT count(*) FROM res r WHERE r.query_id = ex.query_id) AS nr, (SELECT count(*) FROM res r WHERE r.query_id = ex.query_id AND list_contains(expected, r.doc_id)) AS h FROM ex)
    SELECT category::VARCHAR AS category, count(*) AS questions, count(*) FILTER (h = ne) AS passed, round(avg(h / ne::DOUBLE), 6) AS recall, round(avg(coalesce(h / nullif(nr, 0)::DOUBLE, 0)), 6) AS precision FROM s GROUP BY ROLLUP (category)"""
)
def evaluation_report(spark, d):
    found = search.full_text(_doc_nodes(spark, d), None, _bench_queries(spark, d), limit=20, stemmed=False).withColumnRenamed("query_id", "question_id")
    questions = found.where("rank IN (1, 3, 15)").groupBy("question_id").agg(F.collect_list("id").alias("expected")).withColumn("category", (F.col("question_id") % 3).cast("string")).withColumn("preferred_first", F.lit(None).cast("string"))
    return aggregates.evaluation_report(aggregates.evaluate(questions, found.where("rank <= 10")))


@query(
    """WITH c AS (SELECT user_id AS run, event_id AS seq, value AS rate, 300.0 AS ms FROM events),
    m AS (SELECT run, seq, rate, (SELECT median(p.rate) FROM c p WHERE p.run = c.run AND p.seq < c.seq AND p.rate > 0) AS median, (SELECT count(*) FROM c p WHERE p.run = c.run AND p.seq < c.seq AND p.rate > 0) AS n FROM c)
    SELECT run, seq, round(median, 6) AS median, coalesce(n >= 3 AND rate <= 0.3 * median, false) AS drop FROM m"""
)
def throughput_drops(spark, d):
    chunks = table(spark, d, "events").selectExpr("user_id AS run", "event_id AS seq", "value AS rate", "300.0D AS ms")
    return aggregates.throughput_drops(chunks).select("run", "seq", F.round("median", 6).alias("median"), "drop")


@query("WITH s AS (SELECT event_type AS relation_type, 'u' || (user_id % 7) AS source_name, 'v' || (event_id % 5) AS target_name, ts, event_id FROM events) SELECT relation_type, source_name, target_name, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen FROM s GROUP BY 1, 2, 3")
def unknown_relation_counts(spark, d):
    rows = table(spark, d, "events").selectExpr("event_type AS relation_type", "concat('u', user_id % 7) AS source_name", "concat('v', event_id % 5) AS target_name", "ts", "event_id")
    old = rows.where("event_id % 2 = 0").groupBy("relation_type", "source_name", "target_name").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return aggregates.count_upsert(old, rows.where("event_id % 2 = 1"))


# --- upserts, exports ----------------------------------------------------------


@query("WITH o AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) SELECT CASE WHEN o.c_custkey IS NULL THEN 'created' ELSE 'updated' END AS action, count(*) AS n FROM n LEFT JOIN o USING (c_custkey) GROUP BY 1")
def bulk_upsert(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS label", "c_acctbal AS balance")
    _, actions = upsert.upsert(c.where("id % 3 <> 0"), c.where("id % 2 = 0").withColumn("label", F.upper("label")), ["id"], ["label", "balance"])
    return actions.groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE upper(c_name) END AS label FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def import_skip_existing(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS label")
    return upsert.upsert(c.where("id % 3 <> 0"), c.where("id % 2 = 0").withColumn("label", F.upper("label")), ["id"], ["label"], overwrite=False)[0]


@query("SELECT 'unknown_endpoint' AS problem, 'part:' || p_partkey AS subject FROM part WHERE p_partkey % 10 = 0 AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def validate_import(spark, d):
    n = nodes(spark, d)
    made = edges(spark, d).where("relation = 'product_of'")
    return upsert.validate_import(17, 17, n.where("type = 'part' AND CAST(split_part(id, ':', 2) AS bigint) % 10 <> 0"), made, n.where("type = 'supplier'"))


@query(f"{WITH_ALL} SELECT 17 AS schema_version, 't' AS tenant, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def export_header(spark, d):
    return upsert.export_header(nodes(spark, d), edges(spark, d), 17, "t")


@query("SELECT 'chunk:' || substr('c' || conv_id || ':' || turn, 1, 16) AS source, 'chunk:' || substr('c' || conv_id || ':' || nt, 1, 16) AS target FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations) WHERE nt IS NOT NULL")
def chunk_graph(spark, d):
    c = table(spark, d, "conversations").selectExpr("concat('c', conv_id, ':', turn) AS id", "concat('mem/', conv_id, '.md') AS path", "turn AS start_line", "turn AS end_line", "text")
    return files.chunk_graph(c)[1].select("source", "target")


# --- ingest, text functions, streaming -------------------------------------------


@query()
def chunk_markdown(spark, d):
    return ingest.chunk_markdown(table(spark, d, "documents").select("doc_id", "text"), 200).select("doc_id", "index", "start_line", "end_line", F.length("text").alias("n_chars"))


@query(
    """WITH e AS (SELECT conv_id::VARCHAR AS doc, 0 AS src, turn AS seq, CASE turn % 3 WHEN 0 THEN 'decision' ELSE 'observation' END AS kind, trim(text, ' ') AS title, turn::VARCHAR AS started FROM conversations WHERE turn % 3 IN (0, 1)
      UNION ALL SELECT conv_id::VARCHAR, 1, turn, 'decision', 'A decided ' || trim(text, ' '), NULL FROM conversations WHERE role = 'user'),
    f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc, kind, lower(title) ORDER BY src, seq) = 1)
    SELECT doc, min(started) AS started_at, max(started) AS ended_at, count(*) AS event_count FROM f GROUP BY doc"""
)
def episodic_plan(spark, d):
    c = table(spark, d, "conversations")
    ents = c.selectExpr("CAST(conv_id AS string) AS doc", "turn AS seq", "CASE turn % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'event' ELSE 'person' END AS type", "text AS name", "CAST(NULL AS string) AS event_kind", "CAST(turn AS string) AS started", "CAST(NULL AS string) AS ended")
    rels = c.where("role = 'user'").selectExpr("CAST(conv_id AS string) AS doc", "turn AS seq", "'A' AS source", "text AS target", "'decided' AS relation", "CAST(NULL AS string) AS date_start", "CAST(NULL AS string) AS date_end")
    return ingest.episodic_plan(ents, rels)[0]


@query("SELECT page_id, regexp_replace(lower(trim(url)), '\\s+', ' ', 'g') AS alias FROM pages")
def normalized_aliases(spark, d):
    return table(spark, d, "pages").select("page_id", text.normalize_alias(F.col("url")).alias("alias"))


@query("SELECT doc_id, array_to_string(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2)), ' ') IS NOT NULL AS ok, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2)))::BIGINT AS n_terms, md5(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2))), ',')) AS digest FROM documents")
def document_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").isNotNull().alias("ok"), F.size(text.tokens(F.col("text"))).cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort(text.tokens(F.col("text"))), ",")).alias("digest"))


@query(f"{WITH_SCORED} SELECT id, label || chr(10) || type || chr(10) || json_extract_string(properties, '$.nation_id') || chr(10) || json_extract_string(properties, '$.segment') || chr(10) || 'nation_id: ' || json_extract_string(properties, '$.nation_id') || chr(10) || label || ' nation id ' || json_extract_string(properties, '$.nation_id') || chr(10) || 'segment: ' || json_extract_string(properties, '$.segment') || chr(10) || label || ' segment ' || json_extract_string(properties, '$.segment') AS search_text FROM nodes WHERE type = 'customer'")
def node_search_text(spark, d):
    return nodes(spark, d).where("type = 'customer'").select("id", text.search_text(F.col("label"), F.col("type"), F.col("properties")).alias("search_text"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 3 AS k FROM orders UNION ALL SELECT -r_regionkey * 3, make_date(1992 + 4 * r_regionkey::INT, 2, 29), 0 FROM region)
    SELECT o_orderkey, CASE k WHEN 0 THEN 'approximate' WHEN 1 THEN 'exact' ELSE 'range' END AS qualifier,
      CASE k WHEN 0 THEN (d - INTERVAL 1 YEAR)::DATE + CASE WHEN month(d) = 2 AND day(d) = 29 THEN 1 ELSE 0 END WHEN 1 THEN d ELSE make_date(year(d), 1, 1) END::VARCHAR AS lower FROM o"""
)
def fuzzy_dates(spark, d):
    """The days of orders, and leap days, whose year before has none."""
    leap = table(spark, d, "region").selectExpr("-r_regionkey * 3 AS o_orderkey", "CAST(make_date(CAST(1992 + 4 * r_regionkey AS int), 2, 29) AS timestamp_ntz) AS o_orderdate")
    o = table(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS timestamp_ntz) AS o_orderdate").unionByName(leap)
    day, year = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("~"), day)).when(F.col("o_orderkey") % 3 == 1, day).otherwise(F.concat(year, F.lit("/..")))
    p = o.withColumn("e", edtf.parse(raw))
    return p.select("o_orderkey", "e.qualifier", F.col("e.lower").cast("string").alias("lower"))


@query("WITH s AS (SELECT user_id::VARCHAR AS tenant, event_id AS change_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS last FROM events) SELECT tenant, change_id, seq FROM s WHERE seq > last - 5 AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def change_buffer(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id AS change_id", "CAST(user_id AS string) AS tenant", "event_type AS type", "ts", "props AS payload")
    return feed.buffered(rows, "2024-01-31 00:00:00", 5, 10 * 86400).select("tenant", "change_id", F.col("seq").cast("long").alias("seq"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_changes(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id AS change_id", "'all' AS tenant", "event_type AS type", "ts", "props AS payload")
    return feed.windowed_counts(rows).drop("tenant")


# --- search as callers see it, single nodes, histories -----------------------------


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 50 = 0").selectExpr("c_custkey AS query_id", "concat('Tell me about ', c_name, '?') AS text")


_ASKED_SQL = "asked AS (SELECT c_custkey AS query_id, lower(c_name) AS name FROM customer WHERE c_custkey % 50 = 0)"


@query(f"WITH {NODES_SQL}, {_ASKED_SQL} SELECT query_id, min(id) AS id, 1::BIGINT AS rank FROM asked JOIN nodes ON lower(label) = name GROUP BY query_id HAVING count(*) = 1")
def label_rescue(spark, d):
    found = service.rescued(nodes(spark, d), aliases(spark, d), _asked(spark, d))
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(
    f"""{WITH_ALL}, {_ASKED_SQL}, s AS (SELECT query_id, id, 0 AS src, row_number() OVER (PARTITION BY query_id ORDER BY salience_score DESC, updated_at DESC, id) AS place FROM asked JOIN scored ON lower(label) = name AND type = 'customer'),
    e AS (SELECT query_id, id AS seed, target AS other, row_number() OVER (PARTITION BY query_id, id ORDER BY source, target, relation) AS n FROM s JOIN edges ON source = id
      UNION ALL SELECT query_id, id, source, row_number() OVER (PARTITION BY query_id, id ORDER BY source, target, relation) FROM s JOIN edges ON target = id),
    x AS (SELECT DISTINCT query_id, other AS id FROM e WHERE n <= 3 AND other <> seed),
    u AS (SELECT query_id, id, 0 AS src, place, NULL::DOUBLE AS v, NULL::TIMESTAMP AS t FROM s UNION ALL SELECT query_id, id, 1, 0, salience_score, updated_at FROM x JOIN scored USING (id) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = x.query_id AND s.id = x.id))
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY src, place, v DESC, t DESC, id) AS rank FROM u QUALIFY rank <= 5"""
)
def full_text_service(spark, d):
    """The form of a question that has hits is the customer's name; then come its neighbours."""
    n = _scored(spark, d).withColumn("search_text", F.col("label"))
    found = service.full_text_service(n, aliases(spark, d).where("alias_type = 'short'"), edges(spark, d), _asked(spark, d), limit=5, stemmed=False)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"{WITH_SCORED}, b AS (SELECT * REPLACE (true AS user_boosted) FROM nodes WHERE id = 'customer:7') SELECT id, round({SALIENCE_SQL}, 6) AS salience_score FROM b UNION ALL SELECT id, salience_score FROM scored WHERE type = 'customer' AND id <> 'customer:7'")
def boost_node(spark, d):
    return salience.boost(_scored(spark, d).where(F.col("type") == "customer"), "customer:7", AS_OF).select("id", F.round("salience_score", 6).alias("salience_score"))


@query(f"{WITH_SCORED}, b AS (SELECT * REPLACE (CASE WHEN id = 'customer:3' THEN 'customer:4' ELSE superseded_by END AS superseded_by) FROM nodes WHERE type = 'customer') SELECT id, superseded_by, round({SALIENCE_SQL}, 6) AS salience_score FROM b")
def supersede_node(spark, d):
    return salience.supersede(_scored(spark, d).where(F.col("type") == "customer"), "customer:3", "customer:4", AS_OF).select("id", "superseded_by", F.round("salience_score", 6).alias("salience_score"))


@query(f"{WITH_EDGES} SELECT 'neighbour' AS part, CASE WHEN source = 'customer:1' THEN target ELSE source END AS id, relation FROM edges WHERE source = 'customer:1' OR target = 'customer:1' UNION ALL SELECT 'node', 'customer:1', NULL")
def graph_context(spark, d):
    node, _, own = g.context(nodes(spark, d), edges(spark, d), "customer:1")
    other = F.when(F.col("source") == "customer:1", F.col("target")).otherwise(F.col("source"))
    return own.select(F.lit("neighbour").alias("part"), other.alias("id"), "relation").unionByName(node.select(F.lit("node").alias("part"), "id", F.lit(None).cast("string").alias("relation")))


@query("SELECT count(*) FILTER (n_chars < 500) AS missing_text, count(*) FILTER (doc_id % 3 = 0) AS missing_embedding, count(*) FILTER (n_chars < 500 OR doc_id % 3 = 0) AS missing_either, count(*) AS total FROM documents")
def reprocess_counts(spark, d):
    return aggregates.reprocess_counts(table(spark, d, "documents").selectExpr("CASE WHEN n_chars < 500 THEN '  ' ELSE text END AS search_text", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE array(1.0F) END AS embedding"))


_EVALUATED_SQL = "SELECT user_id AS question_id, count(*) FILTER (event_type = '{0}') * 3 > count(*) AS passed, count(*) FILTER (event_type = '{0}') / count(*)::DOUBLE AS recall, count(*) FILTER (event_type = '{0}' AND value > 50) / count(*)::DOUBLE AS precision FROM events GROUP BY 1"


@query(
    f"""WITH a AS ({_EVALUATED_SQL.format("view")}), b AS ({_EVALUATED_SQL.format("click")})
    SELECT question_id, CASE WHEN b.passed AND NOT a.passed THEN 'improved' WHEN a.passed AND NOT b.passed THEN 'regressed' WHEN b.recall > a.recall THEN 'improved' WHEN b.recall < a.recall THEN 'regressed' ELSE 'same' END AS change,
      round(b.recall - a.recall, 6) AS recall_delta, round(b.precision - a.precision, 6) AS precision_delta FROM a JOIN b USING (question_id)"""
)
def compare_evaluations(spark, d):
    def scored(kind: str) -> DataFrame:
        hit = F.col("event_type") == kind
        return table(spark, d, "events").groupBy(F.col("user_id").alias("question_id")).agg((F.count_if(hit) * 3 > F.count("*")).alias("passed"), (F.count_if(hit) / F.count("*")).alias("recall"), (F.count_if(hit & (F.col("value") > 50)) / F.count("*")).alias("precision"))

    found = aggregates.compare_evaluations(scored("view"), scored("click"))
    return found.select("question_id", "change", F.round("recall_delta", 6).alias("recall_delta"), F.round("precision_delta", 6).alias("precision_delta"))


@query("SELECT event_id AS id, event_type AS property_key, ts AS changed_at FROM events WHERE user_id = 5 AND event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5")
def property_history(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id AS id", "CAST(user_id AS string) AS node_id", "event_type AS property_key", "ts AS changed_at")
    return listing.property_history(rows, "5", "view", 20, 5).select("id", "property_key", "changed_at")


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100")
def list_feedback(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id AS id", "event_type AS outcome", "ts AS created_at")
    return listing.list_feedback(rows, "click", 500).select("id", "created_at")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE make_date(year(o_orderdate), month(o_orderdate), 1) END::VARCHAR AS lower, CASE o_orderkey % 3 WHEN 1 THEN NULL ELSE make_date(year(o_orderdate) + 2, 12, 31) END::VARCHAR AS upper,
    CASE o_orderkey % 3 WHEN 0 THEN 'range' WHEN 1 THEN 'exact' ELSE 'estimated' END AS qualifier FROM orders"""
)
def edge_bounds(spark, d):
    """Months from which and years, uncertain ones, up to which something holds."""
    o = table(spark, d, "orders")
    start = F.when(F.col("o_orderkey") % 3 != 2, F.date_format("o_orderdate", "yyyy-MM"))
    end = F.when(F.col("o_orderkey") % 3 != 1, F.concat((F.year("o_orderdate") + 1).cast("string"), F.lit("?")))
    return o.withColumn("e", edtf.edge_bounds(start, end)).select("o_orderkey", F.col("e.lower").cast("string").alias("lower"), F.col("e.upper").cast("string").alias("upper"), "e.qualifier")


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'technology' WHEN 1 THEN 'company' WHEN 2 THEN 'animal' WHEN 3 THEN 'project' WHEN 4 THEN 'gizmo' ELSE 'person' END AS kind,
    CASE event_id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'works_at' WHEN 2 THEN 'located_in' ELSE 'uses' END AS relation, CASE event_id % 3 WHEN 0 THEN 'residence' WHEN 1 THEN 'role' ELSE 'colour' END AS property,
    CASE event_id % 3 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Acme' ELSE 'Inc' END AS label FROM events"""
)
def ingest_aliases(spark, d):
    given = table(spark, d, "events").selectExpr(
        "event_id", "element_at(array(' Tool', 'ORG', 'pet ', 'App', 'Gizmo', 'person'), CAST(event_id % 6 AS int) + 1) AS kind", "element_at(array('Built', 'employed_at', 'lives_in ', 'uses'), CAST(event_id % 4 AS int) + 1) AS relation",
        "element_at(array('Location', 'role_description', 'colour'), CAST(event_id % 3 AS int) + 1) AS property", "element_at(array('Acme, Inc.', 'Acme LLC', 'Inc'), CAST(event_id % 3 AS int) + 1) AS label",
    )
    return given.select(
        "event_id", ingest.aliased(F.col("kind"), ingest.ENTITY_TYPE_ALIASES).alias("kind"), ingest.aliased(F.col("relation"), ingest.RELATION_ALIASES).alias("relation"),
        ingest.aliased(F.col("property"), ingest.FACT_ALIASES).alias("property"), ingest.label_variant(F.col("label")).alias("label"),
    )


_SECOND_SQL = f"""{_EVIDENCE_SQL}, {_CURRENT_SQL},
    c AS (SELECT node_id, property, value, avg(confidence) AS confidence, count(*) AS n, max(ts) AS last FROM ev GROUP BY 1, 2, 3),
    o AS (SELECT c.*, cur.value IS NOT NULL AS has, coalesce(c.value = cur.value, false) AS is_cur, row_number() OVER (PARTITION BY c.node_id, c.property ORDER BY round(confidence, 12) DESC, n DESC, coalesce(c.value = cur.value, false) DESC, last DESC, c.value) AS rn FROM c LEFT JOIN cur USING (node_id, property)),
    s AS (SELECT *, max(CASE WHEN is_cur THEN rn END) OVER (PARTITION BY node_id, property) AS sw FROM o),
    p AS (SELECT *, CASE WHEN sw IS NULL OR (rn <> 1 AND rn <> sw) THEN rn WHEN rn = sw THEN 1 ELSE sw END AS place FROM s)"""


@query(
    f"""WITH {_SECOND_SQL}, b AS (SELECT node_id, property, max(CASE WHEN place = 1 THEN value END) AS preferred_value, max(CASE WHEN place = 2 THEN value END) AS other_value, max(CASE WHEN place = 1 THEN confidence END) AS pc, max(CASE WHEN place = 2 THEN confidence END) AS rc, bool_or(has) AS has FROM p WHERE node_id % 3 = 0 GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN has AND rc IS NOT NULL AND pc - rc < 0.15 THEN 'contested' WHEN NOT has THEN 'superseded' ELSE 'supported' END AS status FROM b)
    SELECT node_id, property, status, preferred_value, other_value FROM k WHERE status <> 'supported' ORDER BY status <> 'contested', node_id, property LIMIT 10"""
)
def contradictions(spark, d):
    ev = _evidence(spark, d)
    ids = table(spark, d, "events").where("user_id % 3 = 0").selectExpr("user_id AS id").distinct()
    return recall.contradictions(facts.claims(ev, _current(ev)), ids, 10)


@query(f"WITH {_EVIDENCE_SQL} SELECT node_id, property, value, source, ts, round(confidence + (node_id % 7) / 100.0, 6) AS score FROM ev WHERE node_id % 3 = 0 ORDER BY score DESC, ts DESC, node_id, property, value LIMIT 10")
def strongest_evidence(spark, d):
    ev = _evidence(spark, d)
    own = table(spark, d, "events").where("user_id % 3 = 0").selectExpr("user_id AS id", "CAST(user_id % 7 AS double) AS salience_score").distinct()
    return recall.strongest_evidence(ev, own, own.select("id"), 10).withColumn("score", F.round("score", 6))


def _customer_maps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("concat('customer:', c_custkey) AS id", "'customer' AS type", "c_name AS label", "map('segment', c_mktsegment, 'nation', CAST(c_nationkey AS string)) AS properties", "c_custkey AS n")


@query(
    """WITH c AS (SELECT c_custkey AS n, c_mktsegment AS s, c_nationkey::VARCHAR AS t FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0)
    SELECT 'customer:' || n AS node_id, 'segment' AS property_key, s AS old_value, lower(s) AS new_value FROM c UNION ALL SELECT 'customer:' || n, 'nation', t, NULL FROM c UNION ALL SELECT 'customer:' || n, 'seen', NULL, 'yes' FROM c"""
)
def upsert_history(spark, d):
    """Every second customer comes twice with other properties; two thirds were known."""
    c = _customer_maps(spark, d)
    new = c.where("n % 2 = 0").withColumn("properties", F.create_map(F.lit("segment"), F.lower(F.element_at("properties", "segment")), F.lit("seen"), F.lit("yes"))).withColumn("seq", F.lit(2))
    first = c.where("n % 2 = 0").withColumn("seq", F.lit(1)).withColumn("label", F.lit("draft"))
    return upsert.upsert_nodes(c.where("n % 3 <> 0").drop("n"), first.unionByName(new).drop("n"), "2024-01-01")[2].drop("changed_at")


@query(
    f"""{WITH_ALL}, c AS (SELECT * FROM nodes WHERE type = 'customer'), k AS (SELECT id, CAST(split_part(id, ':', 2) AS BIGINT) AS n FROM c)
    SELECT 'nodes' AS what, CASE WHEN n % 3 <> 0 THEN 'skipped' ELSE 'created' END AS action, count(*) AS n FROM k GROUP BY ALL
    UNION ALL SELECT 'edges', CASE WHEN length(source) % 2 = 0 THEN 'skipped' ELSE 'created' END, count(*) FROM edges WHERE relation = 'located_in' AND source LIKE 'customer:%' GROUP BY ALL"""
)
def import_counts(spark, d):
    n = nodes(spark, d)
    c, e = n.where(F.col("type") == "customer"), edges(spark, d).where("relation = 'located_in' AND source LIKE 'customer:%'")
    old = n.where("type = 'nation'").unionByName(c.where("CAST(split_part(id, ':', 2) AS bigint) % 3 <> 0"))
    return upsert.import_graph(17, 17, c, e, old, e.where("length(source) % 2 = 0"), dry_run=True, reset_usage=True)[2]


@query("SELECT count(*) AS scanned, count(*) FILTER (n_chars < 500) AS texts_written, count(*) FILTER (doc_id % 3 = 0) AS embeddings_missing, count(*) FILTER (doc_id % 7 = 0) AS superseded, count(*) FILTER (doc_id % 5 = 0) AS with_facts FROM documents")
def maintenance_counters(spark, d):
    rows = table(spark, d, "documents").selectExpr("source AS label", "'document' AS type", "CASE WHEN n_chars < 500 THEN '' ELSE text END AS search_text", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE array(1.0F) END AS embedding", "CASE WHEN doc_id % 7 = 0 THEN 'x' END AS superseded_by", "CASE WHEN doc_id % 5 = 0 THEN '{\"_fact_evidence\":{}}' ELSE '{}' END AS properties")
    return upsert.maintenance_run(rows)[1]


@query(f"{WITH_SCORED} SELECT DISTINCT label AS name FROM (SELECT * FROM scored WHERE salience_score >= 1.0 ORDER BY salience_score DESC, updated_at DESC, id LIMIT 50)")
def known_entities(spark, d):
    return upsert.known_entities(_scored(spark, d))


@query(f"""{WITH_ALL}, r AS (SELECT 'nation:' || n_nationkey AS root FROM nation), p AS (SELECT root, target AS id FROM r JOIN edges ON source = root UNION SELECT root, source FROM r JOIN edges ON target = root) SELECT root, type, count(*) AS n FROM p JOIN nodes USING (id) GROUP BY ALL""")
def neighbor_nodes(spark, d):
    roots = table(spark, d, "nation").selectExpr("concat('nation:', n_nationkey) AS id")
    return g.neighbor_nodes(roots, edges(spark, d), nodes(spark, d)).groupBy("root", "type").agg(F.count("*").alias("n"))


from . import extraction, searching  # noqa: E402, F401 (they register their queries)
