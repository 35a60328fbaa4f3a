"""Queries of the ingest and the feed; importing this module registers them.

What a model would extract is made of the documents' own words: up to twelve names a document, some of
which the text does not hold, edges between neighbours, facts on every third.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosia.functions import text
from mnemosia.operators import compaction, upsert, writing
from mnemosia.operators.graph import folder
from mnemosia.sources import sink
from mnemosia.streaming import feed

from .graph import table
from .registry import query

TYPES = ["person", "project", "technology", "concept", "animal", "service", "gizmo"]
RELATIONS = ["Works_On", "created", "founded", "married_to", "employed_at", "parent_of", "unheard_of", "product_of", "child_of"]


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(docs, entities, relationships, facts)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.when(F.col("doc_id") % 3 == 0, "# USER.md\n").otherwise(""), F.coalesce("text", F.lit(""))).alias("text"), F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 12).alias("w"))
    name = lambda p: f"CASE WHEN {p} % 4 = 1 THEN concat(get(w, {p} - 1), ' Zzz') WHEN {p} % 5 = 4 THEN reverse(get(w, {p} - 1)) ELSE get(w, {p} - 1) END"
    rows = docs.select("doc", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("seq"))
    listed = lambda names, at: f"element_at(array({', '.join(map(repr, names))}), CAST({at} AS int) + 1)"
    ents = rows.selectExpr("doc", "seq", f"{name('seq')} AS name", f"{listed(TYPES, f'(doc + seq) % {len(TYPES)}')} AS type", "CASE WHEN seq % 4 = 0 THEN 'A Voice Model' WHEN seq % 5 = 0 THEN 'potential acquisition target' END AS description", "CASE WHEN seq % 6 = 0 THEN map('birthday', CAST(1900 + (doc + seq) % 50 AS string)) END AS properties")
    rels = rows.where("seq % 2 = 1 AND seq < size(w)").selectExpr("doc", "seq", f"{name('seq')} AS source", f"{name('(seq + 1)')} AS target", f"{listed(RELATIONS, f'(doc + seq) % {len(RELATIONS)}')} AS relation", "CASE doc % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_current", "CASE WHEN doc % 5 = 0 THEN '2020' END AS date_end")
    facts = ents.where("seq % 3 = 0").selectExpr("doc", "seq", "name AS subject", "CASE WHEN seq % 2 = 0 THEN 'birthday' ELSE 'role' END AS property", "CAST(1900 + (doc * 7 + seq * 13) % 100 AS string) AS value")
    return docs.select("doc", "text"), ents, rels, facts


_EXTRACTED_SQL = f"""ex AS (SELECT doc_id AS doc, CASE WHEN doc_id % 3 = 0 THEN '# USER.md' || chr(10) ELSE '' END || coalesce(text, '') AS text, list_slice(string_split(coalesce(text, ''), ' '), 1, 12) AS w FROM documents),
e AS (SELECT doc, seq, CASE WHEN seq % 4 = 1 THEN w[seq] || ' Zzz' WHEN seq % 5 = 4 THEN reverse(w[seq]) ELSE w[seq] END AS name, {TYPES}[(doc + seq) % {len(TYPES)} + 1] AS type, CASE WHEN seq % 4 = 0 THEN 'voice' WHEN seq % 5 = 0 THEN 'target' END AS said, seq % 6 = 0 AS held
  FROM (SELECT doc, w, unnest(range(1, len(w) + 1)) AS seq FROM ex)),
r AS (SELECT doc, seq, name AS source, target, CASE relation WHEN 'Works_On' THEN 'works_on' WHEN 'employed_at' THEN 'works_at' ELSE relation END AS relation, relation AS said, doc % 4 = 1 OR doc % 5 = 0 AS ended
  FROM (SELECT *, lead(name) OVER (PARTITION BY doc ORDER BY seq) AS target, {RELATIONS}[(doc + seq) % {len(RELATIONS)} + 1] AS relation FROM e) WHERE seq % 2 = 1 AND target IS NOT NULL),
f AS (SELECT doc, seq, name AS subject, CASE WHEN seq % 2 = 0 THEN 'birthday' ELSE 'role' END AS property, (1900 + (doc * 7 + seq * 13) % 100)::VARCHAR AS value FROM e WHERE seq % 3 = 0)"""


def _plain(c: str) -> str:
    return f"trim(regexp_replace(lower(translate({c}, ',.()[]{{}}:;' || chr(10) || chr(9) || '-', '             ')), '\\s+', ' ', 'g'))"


@query(
    f"""WITH {_EXTRACTED_SQL},
    p AS (SELECT doc, lower(trim(name)) AS low, CASE type WHEN 'person' THEN 6 WHEN 'project' THEN 5 WHEN 'concept' THEN 4 WHEN 'service' THEN 3 WHEN 'technology' THEN 2 WHEN 'animal' THEN 1 ELSE 0 END + held::INT + CASE said WHEN 'voice' THEN -1 WHEN 'target' THEN -2 ELSE 0 END AS score, 0 AS nr, 0 AS nf, held::INT AS np, true AS own FROM e
      UNION ALL SELECT doc, lower(trim(source)), 3, 1, 0, 0, false FROM r UNION ALL SELECT doc, lower(trim(target)), 3, 1, 0, 0, false FROM r UNION ALL SELECT doc, lower(trim(subject)), 2, 0, 1, 0, false FROM f),
    s AS (SELECT doc, low, sum(score) AS score, sum(nr) AS nr, sum(nf) AS nf, sum(np) AS np FROM p GROUP BY 1, 2 HAVING bool_or(own)),
    t AS (SELECT doc, trim(text) = '' AS blank, {_plain("text")} AS plain FROM ex),
    m AS (SELECT e.*, e.doc % 3 = 0 AS profile, score, nr, nf, np, lower(trim(name)) AS low, CASE type WHEN 'person' THEN 6 WHEN 'project' THEN 5 WHEN 'concept' THEN 4 WHEN 'service' THEN 3 WHEN 'technology' THEN 2 WHEN 'animal' THEN 1 ELSE 0 END AS points, len(string_split_regex(trim(name), '\\s+')) AS fields
      FROM e JOIN t USING (doc) JOIN s ON s.doc = e.doc AND s.low = lower(trim(e.name))
      WHERE trim(name) <> '' AND (blank OR contains(plain, {_plain("name")}) OR (type = 'person' AND len(string_split_regex(trim(name), '\\s+')) >= 2 AND contains(plain, {_plain("string_split_regex(trim(name), '\\s+')[1]")})))),
    k AS (SELECT * FROM m WHERE CASE WHEN NOT profile THEN score >= 2 WHEN type = 'person' THEN nr > 0 OR nf > 0 OR np > 0 WHEN type IN ('project', 'concept') THEN NOT (coalesce(said, '') = 'target' AND nf = 0) AND score >= 5
        WHEN type = 'service' THEN low = 'scout' OR nr >= 2 OR (nf >= 3 AND coalesce(said, '') <> 'voice') WHEN type = 'technology' THEN nr >= 2 OR nf >= 3 WHEN type = 'animal' THEN fields >= 2 AND (nr >= 2 OR nf >= 2) ELSE false END
      QUALIFY row_number() OVER (PARTITION BY doc, low ORDER BY points DESC, seq) = 1),
    z AS (SELECT * FROM k QUALIFY NOT profile OR row_number() OVER (PARTITION BY doc ORDER BY score DESC, low) <= 12),
    zr AS (SELECT r.* FROM r WHERE (doc, lower(trim(source))) IN (SELECT doc, low FROM z) AND (doc, lower(trim(target))) IN (SELECT doc, low FROM z)
      QUALIFY row_number() OVER (PARTITION BY doc, CASE WHEN said = 'married_to' THEN least(lower(trim(source)), lower(trim(target))) ELSE lower(trim(source)) END, CASE WHEN said = 'married_to' THEN greatest(lower(trim(source)), lower(trim(target))) ELSE lower(trim(target)) END, said ORDER BY seq) = 1),
    zf AS (SELECT * FROM f WHERE (doc, lower(trim(subject))) IN (SELECT doc, low FROM z) QUALIFY row_number() OVER (PARTITION BY doc, lower(trim(subject)), property ORDER BY seq) = 1)
    SELECT doc, 'entity' AS part, name AS subject, type AS what, NULL AS object FROM z UNION ALL SELECT doc, 'relationship', source, said, target FROM zr UNION ALL SELECT doc, 'fact', subject, property, value FROM zf"""
)
def document_compaction(spark, d):
    """Entities that their document mentions and supports, and the edges and facts that are left."""
    ents, rels, facts = compaction.compact(*_extracted(spark, d))
    out = ents.select("doc", F.lit("entity").alias("part"), F.col("name").alias("subject"), F.col("type").alias("what"), F.lit(None).cast("string").alias("object"))
    out = out.unionByName(rels.select("doc", F.lit("relationship").alias("part"), F.col("source").alias("subject"), F.col("relation").alias("what"), F.col("target").alias("object")))
    return out.unionByName(facts.select("doc", F.lit("fact").alias("part"), "subject", F.col("property").alias("what"), F.col("value").alias("object")))


@query(
    f"""WITH {_EXTRACTED_SQL},
    ty AS (SELECT doc, lower(trim(name)) AS low, arg_max(type, seq) AS kind FROM e GROUP BY 1, 2),
    bd AS (SELECT doc, low, arg_max(v, rank) AS born FROM (SELECT doc, lower(trim(name)) AS low, seq AS rank, (1900 + (doc + seq) % 50)::VARCHAR AS v FROM e WHERE held UNION ALL SELECT doc, lower(trim(subject)), 1000 + seq, value FROM f WHERE property = 'birthday') GROUP BY 1, 2),
    o AS (SELECT r.*, a.kind AS ak, b.kind AS bk, x.born AS ab, y.born AS bb FROM r LEFT JOIN ty a ON a.doc = r.doc AND a.low = lower(trim(source)) LEFT JOIN ty b ON b.doc = r.doc AND b.low = lower(trim(target))
      LEFT JOIN bd x ON x.doc = r.doc AND x.low = lower(trim(source)) LEFT JOIN bd y ON y.doc = r.doc AND y.low = lower(trim(target)) WHERE trim(source) <> '' AND trim(target) <> '' AND lower(source) <> lower(target)),
    q AS (SELECT doc, seq, CASE WHEN relation = 'created' AND ak = 'project' AND bk = 'person' THEN target ELSE source END AS source, CASE WHEN relation = 'created' AND ak = 'project' AND bk = 'person' THEN source ELSE target END AS target,
      CASE WHEN relation IN ('product_of', 'founded') AND ak = 'person' AND bk = 'project' THEN 'created' WHEN relation = 'works_at' AND ended THEN 'worked_at' WHEN relation = 'parent_of' AND ab > bb THEN 'child_of' WHEN relation = 'child_of' AND ab < bb THEN 'parent_of' ELSE relation END AS relation FROM o WHERE relation <> 'unheard_of')
    SELECT doc, source, relation, target FROM q QUALIFY row_number() OVER (PARTITION BY doc, CASE WHEN relation = 'married_to' THEN least(lower(trim(source)), lower(trim(target))) ELSE lower(trim(source)) END, CASE WHEN relation = 'married_to' THEN greatest(lower(trim(source)), lower(trim(target))) ELSE lower(trim(target)) END, relation ORDER BY seq) = 1"""
)
def edge_orientation(spark, d):
    """Edges whose relation and direction fit the kinds and birthdays of both ends."""
    _, ents, rels, facts = _extracted(spark, d)
    return compaction.oriented(rels, ents, facts).select("doc", "source", "relation", "target")


@query(
    """WITH v AS (SELECT user_id AS node_id, event_type AS property, event_id AS seq, floor(value / 50)::BIGINT::VARCHAR AS value, 'src' || (event_id % 3) AS source FROM events),
    h AS (SELECT *, lag(value) OVER w AS old, row_number() OVER w AS n, lead(seq) OVER w IS NULL AS last FROM v WINDOW w AS (PARTITION BY node_id, property ORDER BY seq))
    SELECT 'history' AS part, node_id, property, seq, old AS old_value, value AS new_value, source FROM h WHERE n > 1 AND old IS DISTINCT FROM value UNION ALL SELECT 'current', node_id, property, seq, NULL, value, NULL FROM h WHERE last"""
)
def property_merge(spark, d):
    """The events of each user as versions of its properties: what stays, and every conflict on the way."""
    rows = table(spark, d, "events").selectExpr("user_id AS node_id", "event_type AS property", "event_id AS seq", "CAST(CAST(floor(value / 50) AS bigint) AS string) AS value", "concat('src', event_id % 3) AS source", "ts AS changed_at")
    current, history = writing.merged_versions(rows)
    first = history.select(F.lit("history").alias("part"), "node_id", "property", "seq", "old_value", "new_value", "source")
    none = F.lit(None)
    return first.unionByName(current.select(F.lit("current").alias("part"), "node_id", "property", "seq", none.cast("string").alias("old_value"), F.col("value").alias("new_value"), none.cast("string").alias("source")))


_KEYED = "substr(md5(CAST(o_orderkey % 40 AS {0})), 1, 8)"


@query(
    f"""WITH e AS (SELECT o_orderkey AS seq, o_orderpriority AS p, CASE WHEN o_orderkey % 5 < 2 THEN c_name ELSE 'vendor ' || {_KEYED.format("VARCHAR")} END AS who, o_orderkey % 5 < 2 AS known,
      CASE o_orderkey % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name || ' Inc.' WHEN 2 THEN 'Vendor ' || {_KEYED.format("VARCHAR")} WHEN 3 THEN 'vendor ' || {_KEYED.format("VARCHAR")} || ', Inc.' ELSE ' VENDOR ' || {_KEYED.format("VARCHAR")} END AS name FROM orders JOIN customer ON c_custkey = o_custkey),
    h AS (SELECT *, lag(p) OVER (PARTITION BY who ORDER BY seq) AS old FROM e)
    SELECT CASE WHEN known THEN who ELSE trim(arg_min(name, seq)) END AS label, count(*) AS n_rows, CASE WHEN known THEN 0 ELSE 1 END::BIGINT AS n_created, count(*) FILTER (old IS NOT NULL AND old <> p) AS n_conflicts, arg_max(p, seq) AS priority FROM h GROUP BY who, known"""
)
def entity_writes(spark, d):
    """Orders name customers that the graph has, in capitals or with a company's ending, and vendors that it has not."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    key = _KEYED.format("string")
    name = f"CASE o_orderkey % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN concat(c_name, ' Inc.') WHEN 2 THEN concat('Vendor ', {key}) WHEN 3 THEN concat('vendor ', {key}, ', Inc.') ELSE concat(' VENDOR ', {key}) END"
    entities = o.selectExpr("o_orderkey AS seq", f"{name} AS name", "'customer' AS type", "map('priority', o_orderpriority) AS properties")
    nodes = table(spark, d, "customer").selectExpr("concat('customer:', c_custkey) AS id", "'customer' AS type", "c_name AS label", "map('segment', c_mktsegment) AS properties")
    none = spark.createDataFrame([], "node_id string, alias string, normalized_alias string")
    got = writing.write_entities(nodes, none, entities, "orders", "2024-01-01T00:00:00Z")
    sums = got["actions"].groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("action") == "created").alias("n_created"))
    conflicts = got["history"].groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n_conflicts"))
    met = sums.join(got["nodes"], "id").join(conflicts, "id", "left")
    return met.select("label", "n_rows", "n_created", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), F.element_at("properties", "priority").alias("priority"))


@query(
    """WITH s AS (SELECT user_id::VARCHAR AS tenant, event_id AS change_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS last, max(ts) OVER (PARTITION BY user_id) AS newest FROM events)
    SELECT tenant, change_id, seq FROM s WHERE seq > last - 20 AND ts >= newest - INTERVAL 10 DAY"""
)
def change_feed(spark, d):
    """The events published in three parts and numbered as a stream that is stopped and started between them: what can be replayed."""
    rows = table(spark, d, "events").selectExpr("event_id AS change_id", "CAST(user_id AS string) AS tenant", "event_type AS type", "ts", "props AS payload")
    place = f"{folder(spark)}/feed-{uuid.uuid4().hex}"
    one, two = (F.col("ts") < F.lit(day).cast("timestamp_ntz") for day in ("2024-01-11", "2024-01-21"))
    for part in (one, two & ~one, ~two):
        feed.publish(rows.where(part), f"{place}/log")
        feed.run_numbering(spark, f"{place}/log", f"{place}/state", f"{place}/numbered", 20, 10 * 86400)
    return feed.held(spark, f"{place}/state").select("tenant", "change_id", "seq")


def _lengths_but(divisor: int):
    """Stands for an embedder: the length of each text; it refuses texts whose length is a multiple of divisor."""

    def embed(texts: list[str]) -> list[list[float]]:
        if any(len(t) % divisor == 0 for t in texts):
            raise ConnectionError("refused")
        return [[float(len(t))] for t in texts]

    return embed


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS runs, length(coalesce(text, '')) % 14 <> 0 AS done, CASE WHEN length(coalesce(text, '')) % 14 <> 0 THEN length(text) ELSE -1 END::BIGINT AS size FROM documents")
def failure_ledger(spark, d):
    """Two runs of a sink: the second takes up what the first could not do, and some stay dead letters."""
    docs = table(spark, d, "documents").selectExpr("CAST(doc_id AS string) AS id", "text")
    ledger = sink.Ledger(spark, f"{folder(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.write(docs, 0, _lengths_but(7), attempts=1, breaker=1_000_000_000)
    ledger.write(docs.where("false"), 1, _lengths_but(14), attempts=1, breaker=1_000_000_000)
    done = F.col("error").isNull()
    return ledger.latest().select(F.col("id").cast("long").alias("doc_id"), "runs", done.alias("done"), F.when(done, F.get("result", F.lit(0)).cast("long")).otherwise(-1).alias("size"))


def _order_extraction(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, entities, relationships, facts): each order names its customer or a vendor, who has to do with a customer or with nobody known."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    key = _KEYED.format("string")
    name = f"CASE o_orderkey % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN concat(c_name, ' Inc.') WHEN 2 THEN concat('Vendor ', {key}) WHEN 3 THEN concat('vendor ', {key}, ', Inc.') ELSE concat(' VENDOR ', {key}) END"
    entities = o.selectExpr("o_orderkey AS seq", f"{name} AS name", "'customer' AS type", "map('priority', o_orderpriority) AS properties")
    rels = o.selectExpr(
        "o_orderkey AS seq", f"{name} AS source", "CASE WHEN o_orderkey % 11 = 0 THEN concat('Nobody ', o_orderkey % 7) ELSE c_name END AS target", "element_at(array('uses', 'located_in', 'unheard_of'), CAST(o_orderkey % 3 AS int) + 1) AS relation",
        "CAST(o_orderkey % 10 AS double) / 10 AS confidence", "CASE WHEN o_orderkey % 4 = 0 THEN CAST(CAST(o_orderdate AS date) AS string) END AS date_start", "CAST(NULL AS string) AS date_end", "CAST(NULL AS boolean) AS is_current",
    )
    facts = o.selectExpr("o_orderkey AS seq", "CASE WHEN o_orderkey % 13 = 0 THEN 'Nobody at all' ELSE c_name END AS subject", "'status' AS property", "o_orderstatus AS value")
    nodes = table(spark, d, "customer").selectExpr("concat('customer:', c_custkey) AS id", "'customer' AS type", "c_name AS label", "map('segment', c_mktsegment) AS properties")
    return nodes, entities, rels, facts


_ORDER_SQL = f"""e AS (SELECT o_orderkey AS seq, o_orderkey % 5 < 2 AS known, CASE WHEN o_orderkey % 5 < 2 THEN c_name ELSE 'vendor ' || {_KEYED.format("VARCHAR")} END AS who, c_name, o_orderdate::DATE::VARCHAR AS day, o_orderstatus,
  CASE o_orderkey % 5 WHEN 2 THEN 'Vendor ' || {_KEYED.format("VARCHAR")} WHEN 3 THEN 'vendor ' || {_KEYED.format("VARCHAR")} || ', Inc.' WHEN 4 THEN 'VENDOR ' || {_KEYED.format("VARCHAR")} END AS vendor FROM orders JOIN customer ON c_custkey = o_custkey),
v AS (SELECT who, CASE WHEN known THEN who ELSE arg_min(vendor, seq) END AS label FROM e GROUP BY who, known),
r AS (SELECT seq, label AS source, c_name AS target, ['uses', 'located_in', 'unheard_of'][seq % 3 + 1] AS relation, (seq % 10)::DOUBLE / 10 AS confidence, CASE WHEN seq % 4 = 0 THEN day END AS date_start, seq % 11 = 0 AS lost FROM e JOIN v USING (who))"""


@query(
    f"""WITH {_ORDER_SQL} SELECT source, target, relation, arg_max(confidence, seq) AS confidence, arg_max(date_start, seq) FILTER (date_start IS NOT NULL) AS date_start FROM r WHERE NOT lost AND relation <> 'unheard_of' GROUP BY 1, 2, 3"""
)
def relationship_writes(spark, d):
    """The edges of an ingest: ends by what the batch wrote or by resolution, the last confidence, the last date that is given."""
    nodes, entities, rels, facts = _order_extraction(spark, d)
    none, edges = spark.createDataFrame([], "node_id string, alias string, normalized_alias string"), spark.createDataFrame([], "source string, target string, relation string")
    got = writing.write_extraction(nodes, none, edges, entities, rels, facts, "orders", "2024-01-01T00:00:00Z")
    label = got["nodes"].select("id", "label")
    met = got["edges"].join(label.select(F.col("id").alias("source"), F.col("label").alias("a")), "source").join(label.select(F.col("id").alias("target"), F.col("label").alias("b")), "target")
    return met.select(F.col("a").alias("source"), F.col("b").alias("target"), "relation", "confidence", "date_start")


@query(
    f"""WITH {_ORDER_SQL} SELECT count(*) AS entities, count(*) AS relationships, count(*) AS facts, (SELECT count(*) FROM (SELECT DISTINCT who FROM e WHERE NOT known)) AS created_nodes, count(*) - (SELECT count(*) FROM (SELECT DISTINCT who FROM e WHERE NOT known)) AS updated_nodes,
    (SELECT count(*) FROM r WHERE NOT lost AND relation <> 'unheard_of') AS written_edges, (SELECT count(*) FROM r WHERE lost OR relation = 'unheard_of') AS skipped_edges, (SELECT count(*) FROM r WHERE NOT lost AND relation = 'unheard_of') AS unknown_relations, count(*) FILTER (seq % 13 = 0) AS skipped_facts FROM e"""
)
def ingest_report(spark, d):
    """What an ingest of the orders did."""
    nodes, entities, rels, facts = _order_extraction(spark, d)
    none, edges = spark.createDataFrame([], "node_id string, alias string, normalized_alias string"), spark.createDataFrame([], "source string, target string, relation string")
    return writing.write_extraction(nodes, none, edges, entities, rels, facts, "orders", "2024-01-01T00:00:00Z")["report"]


def _import(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(new nodes, new edges, nodes, edges): customers of which some are known, and the orders of each as edges."""
    c = table(spark, d, "customer").selectExpr("c_custkey AS k", "concat('customer:', c_custkey) AS id", "c_name AS label", "CAST(c_custkey % 9 AS bigint) AS access_count", "array(CAST(c_acctbal AS float)) AS embedding")
    old, new = c.where("k % 3 <> 0").drop("k"), c.where("k % 2 = 0").withColumn("label", F.upper("label")).drop("k")
    e = table(spark, d, "orders").selectExpr("concat('customer:', o_custkey) AS source", "concat('customer:', o_custkey % 10 + 1) AS target", "'uses' AS relation", "CAST(o_orderkey AS double) AS weight", "o_custkey AS k")
    own = e.where("k % 6 <> 3").groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"))
    return new, own.where("weight % 2 = 0"), old, own.where("weight % 2 = 1")


_IMPORT_SQL = """c AS (SELECT c_custkey AS k, 'customer:' || c_custkey AS id, c_name AS label, c_custkey % 9 AS n FROM customer),
w AS (SELECT 'customer:' || o_custkey AS source, 'customer:' || (o_custkey % 10 + 1) AS target, max(o_orderkey) AS weight FROM orders WHERE o_custkey % 6 <> 3 GROUP BY 1, 2),
u AS (SELECT DISTINCT id FROM (SELECT source AS id FROM w WHERE weight % 2 = 0 UNION ALL SELECT target FROM w WHERE weight % 2 = 0) WHERE id NOT IN (SELECT id FROM c WHERE k % 2 = 0 OR k % 3 <> 0))"""


@query(
    f"""WITH {_IMPORT_SQL} SELECT 'schema_version_too_new' AS problem, '18' AS subject UNION ALL SELECT 'empty_node_id', upper(label) FROM c WHERE k % 40 = 0
    UNION ALL SELECT DISTINCT 'unknown_endpoint', id FROM (SELECT source AS id FROM w WHERE weight % 2 = 0 UNION ALL SELECT target FROM w WHERE weight % 2 = 0) WHERE id NOT IN (SELECT id FROM c WHERE k % 40 <> 0 AND k % 2 = 0 OR k % 3 <> 0 AND k % 10 <> 0)"""
)
def import_problems(spark, d):
    """A newer schema, nodes without id, and edges whose ends are neither imported nor there."""
    new, new_edges, nodes, _ = _import(spark, d)
    number = F.split_part("id", F.lit(":"), F.lit(2)).cast("long")
    return upsert.validate_import(18, 17, new.withColumn("id", F.when(number % 40 == 0, "  ").otherwise(F.col("id"))), new_edges, nodes.where(number % 10 != 0)).distinct()


@query(
    f"""WITH {_IMPORT_SQL}, i AS (SELECT * FROM w WHERE source IN (SELECT id FROM c WHERE k % 2 = 0 OR k % 3 <> 0) AND target IN (SELECT id FROM c WHERE k % 2 = 0 OR k % 3 <> 0)) SELECT 'node' AS part, id AS subject, CASE WHEN k % 2 = 0 THEN upper(label) ELSE label END AS label, CASE WHEN k % 2 = 0 THEN 0 ELSE n END::BIGINT AS n, k % 2 <> 0 AS embedded FROM c WHERE k % 2 = 0 OR k % 3 <> 0
    UNION ALL SELECT 'edge', source || '>' || target, 'uses', weight, false FROM i UNION ALL SELECT 'count', 'nodes', CASE WHEN k % 3 <> 0 THEN 'updated' ELSE 'created' END, count(*), false FROM c WHERE k % 2 = 0 GROUP BY 3
    UNION ALL SELECT 'count', 'edges', 'created', count(*), false FROM i WHERE weight % 2 = 0"""
)
def import_graph(spark, d):
    """An import that overwrites, resets usage and leaves vectors to be made anew: both tables after it, and its counts."""
    new, new_edges, nodes, edges = _import(spark, d)
    known = new.union(nodes).select("id").distinct()
    inside = lambda e: e.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    after, after_edges, counts = upsert.import_graph(17, 17, new, inside(new_edges), nodes, inside(edges), overwrite=True, reset_usage=True, regenerate_embeddings=True)
    none = F.lit(False)
    out = after.select(F.lit("node").alias("part"), F.col("id").alias("subject"), "label", F.col("access_count").alias("n"), F.col("embedding").isNotNull().alias("embedded"))
    out = out.unionByName(after_edges.select(F.lit("edge").alias("part"), F.concat_ws(">", "source", "target").alias("subject"), F.col("relation").alias("label"), F.col("weight").cast("long").alias("n"), none.alias("embedded")))
    return out.unionByName(counts.where("n > 0").select(F.lit("count").alias("part"), F.col("what").alias("subject"), F.col("action").alias("label"), "n", none.alias("embedded")))


@query("SELECT c_custkey AS id, c_custkey % 3 <> 2 AS same FROM customer")
def canonical_properties(spark, d):
    """JSON texts that differ only in order and blanks are equal, others are not."""
    c = table(spark, d, "customer")
    one = F.expr("concat('{\"name\": \"', c_name, '\", \"of\": {\"b\": [1, 2], \"a\": ', c_nationkey, '}}')")
    two = F.when(F.col("c_custkey") % 3 == 2, F.expr("concat('{\"of\":{\"a\":', c_nationkey, ',\"b\":[2,1]},\"name\":\"', c_name, '\"}')")).otherwise(F.expr("concat('{\"of\":{\"a\":', c_nationkey, ',\"b\":[1,2]}, \"name\":\"', c_name, '\"}')"))
    return c.select(F.col("c_custkey").alias("id"), (text.canonical_json(one) == text.canonical_json(two)).alias("same"))
