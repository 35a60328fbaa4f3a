"""Queries of search over stored postings and of shaping; importing this module registers them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosia.functions.text import STEM_SUFFIXES, intent_of, normalize_alias
from mnemosia.operators import aggregates, listing, postings, rank, resolve, session, shaping
from mnemosia.operators.search import top

from .graph import ALIASES_SQL, NODES_SQL, SCORED_SQL, aliases, table
from .registry import _scored, query

_WORDS = r"[^\p{L}\p{N}]+"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Two words of each benchmark item, the third and the fourth."""
    words = F.filter(F.split(F.lower("text"), _WORDS), lambda x: F.octet_length(x) >= 2)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.get(words, F.lit(2)), F.get(words, F.lit(3))).alias("text"))


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    """Some queries as aliases of the node of that number: in capitals, spread out, or with a word more."""
    asked = _asked(spark, d).where("query_id % 4 > 0")
    alias = F.when(F.col("query_id") % 4 == 1, F.upper("text")).when(F.col("query_id") % 4 == 2, F.replace("text", F.lit(" "), F.lit("   "))).otherwise(F.concat("text", F.lit(" extra")))
    out = asked.select(F.lpad(F.col("query_id").cast("string"), 12, "0").alias("node_id"), alias.alias("alias"))
    return out.select("node_id", "alias", normalize_alias(F.col("alias")).alias("normalized_alias"))


_STEM = "regexp_replace(regexp_replace({0}, '^(.{{3,}}?)(?:" + "|".join(STEM_SUFFIXES) + ")$', '\\1'), '(.{{3,}})(?:e|y|i)$', '\\1')"
_SPLIT = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2)"
_POSTINGS_SQL = f"""qw AS (SELECT item_id AS query_id, concat_ws(' ', w[3], w[4]) AS text FROM (SELECT item_id, {_SPLIT.format("text")} AS w FROM benchmark)),
al AS (SELECT lpad(query_id::VARCHAR, 12, '0') AS id, CASE query_id % 4 WHEN 1 THEN upper(text) WHEN 2 THEN replace(text, ' ', '   ') ELSE text || ' extra' END AS ref FROM qw WHERE query_id % 4 > 0),
tx AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, '' AS ref, coalesce(text, '') AS text FROM documents UNION ALL SELECT DISTINCT id, ref, ref FROM al WHERE trim(ref) <> ''),
tw AS (SELECT id, ref, list_transform({_SPLIT.format("text")}, lambda x: {_STEM.format("x")}) AS w FROM tx),
ql AS (SELECT query_id, text, list_distinct(list_transform(list_distinct({_SPLIT.format("text")}), lambda x: {_STEM.format("x")})) AS l FROM qw),
qx AS (SELECT query_id, len(l) AS need, unnest(l) AS lexeme FROM ql),
ps AS (SELECT id, ref, lexeme, pl FROM (SELECT id, ref, unnest(range(1, len(w) + 1)) AS pl, unnest(w) AS lexeme FROM tw) WHERE lexeme IN (SELECT lexeme FROM qx) QUALIFY row_number() OVER (PARTITION BY id, ref, lexeme ORDER BY pl) <= 255),
hv AS (SELECT query_id, id, ref, need FROM (SELECT DISTINCT lexeme, id, ref FROM ps) JOIN qx USING (lexeme) GROUP BY ALL HAVING count(*) = need),
r1 AS (SELECT query_id, id, ref, sum(0.1 / (n * n)) / 1.64493406685 AS match FROM (SELECT hv.query_id, hv.id, hv.ref, row_number() OVER (PARTITION BY hv.query_id, hv.id, hv.ref ORDER BY pl) AS n FROM hv JOIN qx USING (query_id) JOIN ps ON ps.lexeme = qx.lexeme AND ps.id = hv.id AND ps.ref = hv.ref WHERE hv.need = 1) GROUP BY 1, 2, 3),
r2 AS (SELECT hv.query_id, hv.id, hv.ref, 1 - exp(sum(ln(1 - CASE WHEN abs(a.pl - b.pl) > 100 THEN 1e-16 ELSE 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a.pl - b.pl) / 1.5 - 2))) END))) AS match
  FROM hv JOIN qx x ON x.query_id = hv.query_id JOIN qx y ON y.query_id = hv.query_id AND x.lexeme < y.lexeme JOIN ps a ON a.lexeme = x.lexeme AND a.id = hv.id AND a.ref = hv.ref JOIN ps b ON b.lexeme = y.lexeme AND b.id = hv.id AND b.ref = hv.ref WHERE hv.need = 2 GROUP BY 1, 2, 3),
mt AS (SELECT query_id, id, CASE WHEN ref = '' THEN match ELSE match * 0.9 END AS match FROM (FROM r1 UNION ALL FROM r2) UNION ALL SELECT query_id, id, 1.0 FROM ql JOIN al ON lower(ref) = lower(text) UNION ALL SELECT query_id, id, 0.95 FROM ql JOIN al ON regexp_replace(trim(lower(ref)), '\\s+', ' ', 'g') = regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')),
bs AS (SELECT query_id, id, max(match) AS match FROM mt GROUP BY 1, 2)"""


@query(
    f"""WITH {_POSTINGS_SQL}, nd AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, doc_id, 1.0 + doc_id % 50 AS salience FROM documents),
    sc AS (SELECT query_id, id, doc_id, round(match, 6) AS match, round(match * 0.8 + least(salience / 100.0, 1.0) * 0.2, 9) AS score, salience FROM bs JOIN nd USING (id))
    SELECT query_id, doc_id, match, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, salience DESC, id) AS rank FROM sc) WHERE rank <= 10"""
)
def postings_search(spark, d):
    """Stemmed words, nearness and aliases, over stored postings."""
    rows = table(spark, d, "documents").selectExpr("lpad(CAST(doc_id AS string), 12, '0') AS id", "'document' AS type", "coalesce(text, '') AS search_text", "CAST(1 + doc_id % 50 AS double) AS salience_score", "1 AS updated_at")
    own = _aliases(spark, d)
    found = postings.search(postings.build(rows, own), rows, own, _asked(spark, d), limit=10)
    return found.select("query_id", F.col("id").cast("long").alias("doc_id"), F.round("match", 6).alias("match"), F.col("rank").cast("long").alias("rank"))


_TEXTS = ["What happened to {} in 1995?", "Is {} related to the latest orders?", "How to bill {}", "Who is {}", "{}"]
_INTENTS_SQL = "['temporal', 'relationship', 'procedural', 'entity', 'general']"
_ASKED_SQL = " ".join(f"WHEN {k} THEN " + " || ".join(x for x in (f"'{t.split('{}')[0]}'", "c_name", f"'{t.split('{}')[1]}'") if x != "''") for k, t in enumerate(_TEXTS))


def _shaping_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(queries of five intents about some customers, the thirty most salient customers of the same nation for each, nodes, beliefs)."""
    asked = table(spark, d, "customer").where("c_custkey % 30 = 0").withColumn("k", (F.col("c_custkey") / 30).cast("int") % len(_TEXTS))
    forms = F.array(*[F.concat(F.lit(t.split("{}")[0]), F.col("c_name"), F.lit(t.split("{}")[1])) for t in _TEXTS])
    queries = asked.select(F.col("c_custkey").alias("query_id"), "c_nationkey", F.get(forms, F.col("k")).alias("text"))
    nodes = _scored(spark, d).where("type = 'customer'").withColumn("search_text", F.concat("properties", F.lit(" since 199"), F.substring("id", -1, 1)))
    near = nodes.withColumn("nation", F.get_json_object("properties", "$.nation_id").try_cast("long"))
    # the queries of a nation have the same candidates, so a nation is ordered once, whatever their number
    first = top(near.withColumn("query_id", F.col("nation")), 30, F.desc("salience_score"), F.asc("id")).select("nation", "id", "rank")
    candidates = queries.join(first, F.col("nation") == F.col("c_nationkey")).select("query_id", "id", "rank")
    beliefs = nodes.selectExpr("id", "CASE WHEN user_boosted THEN 'supported' ELSE 'contested' END AS status", "access_count AS evidence_count", "0.5D AS preferred_confidence", "access_count % 2 = 0 AS matches_current", "updated_at AS last_observed")
    return queries, candidates, nodes, beliefs


_SHAPED_SQL = f"""{NODES_SQL}, {SCORED_SQL},
qs AS (SELECT c_custkey AS query_id, c_nationkey, (c_custkey // 30) % 5 AS k, CASE (c_custkey // 30) % 5 {_ASKED_SQL} END AS asked FROM customer WHERE c_custkey % 30 = 0),
cd AS (SELECT query_id, k, asked, s.*, lower(trim(label)) AS low, lower(properties || ' since 199' || id[-1:]) AS text, row_number() OVER (PARTITION BY query_id ORDER BY salience_score DESC, id) AS rank
  FROM qs JOIN scored s ON s.type = 'customer' AND json_extract_string(properties, '$.nation_id')::BIGINT = c_nationkey QUALIFY rank <= 30),
ws AS (SELECT *, greatest(0, (epoch(max(updated_at) OVER w) - epoch(updated_at)) / 86400.0) AS age, least(greatest((epoch(updated_at) - min(epoch(updated_at)) OVER w) / nullif(max(epoch(updated_at)) OVER w - min(epoch(updated_at)) OVER w, 0), 0.0), 1.0) AS pos FROM cd WINDOW w AS (PARTITION BY query_id)),
bl AS (SELECT *, least(greatest(0.35 / rank + CASE WHEN user_boosted THEN 0.32 ELSE -0.18 END + least(access_count, 4) * 0.05 + 0.5 * 0.08 + CASE WHEN access_count % 2 = 0 THEN 0.08 ELSE 0.0 END + greatest(0, 1 - age / 365.0) * 0.08, -0.8), 0.8) AS belief,
  greatest(-0.2, list_max(list_transform([year(updated_at), year(created_at), 1990 + id[-1:]::INT], lambda y: CASE abs(y - 1995) WHEN 0 THEN 0.45 WHEN 1 THEN 0.18 WHEN 2 THEN 0.08 WHEN 3 THEN 0.08 ELSE -least(abs(y - 1995) / 20.0, 0.2) END))) AS years,
  list_distinct(list_filter(regexp_split_to_array(lower(asked), '[^A-Za-z0-9]+'), lambda x: strlen(x) >= 2)) AS terms FROM ws)"""


@query(
    f"""WITH {_SHAPED_SQL}, sc AS (SELECT *, round(belief + CASE k WHEN 0 THEN least(greatest(0.08 / rank + coalesce((1 - pos) * 0.35, 0.0) + years, -0.9), 0.9) WHEN 1 THEN least(greatest(0.08 / rank + coalesce(pos * 0.35, 0.0), -0.9), 0.9) ELSE 0.0 END, 9) AS score FROM bl)
    SELECT query_id, {_INTENTS_SQL}[k + 1] AS intent, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, salience_score DESC, updated_at DESC, id) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, salience_score DESC, updated_at DESC, id) <= 10"""
)
def intent_shaping(spark, d):
    """Results of queries of all five intents, shaped by time and beliefs in one plan."""
    queries, candidates, nodes, beliefs = _shaping_inputs(spark, d)
    found = shaping.shaped(candidates, queries, nodes, beliefs, 10).join(queries.select("query_id", intent_of(F.col("text")).alias("intent")), "query_id")
    return found.select("query_id", "intent", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_SHAPED_SQL}, sc AS (SELECT *, round(belief + list_sum(list_transform(terms, lambda t: CASE WHEN contains(low, t) THEN 2.5 WHEN contains(text, t) THEN 1.2 ELSE 0.0 END)) + len(list_filter(terms, lambda t: contains(low, t) OR contains(text, t))) / len(terms)::DOUBLE * 3
      + CASE WHEN low = lower(asked) THEN 10 ELSE 0 END + CASE WHEN contains(low, lower(asked)) THEN 4 ELSE 0 END + CASE WHEN user_boosted THEN 0.4 ELSE 0.0 END + least(salience_score / 100, 1.5) + 1.0 / rank, 9) AS score FROM bl)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, salience_score DESC, updated_at DESC, id) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, salience_score DESC, updated_at DESC, id) <= 10"""
)
def service_rerank(spark, d):
    """The first thirty candidates of each query by its own terms and what is believed, in one plan."""
    queries, candidates, nodes, beliefs = _shaping_inputs(spark, d)
    found = shaping.reranked(candidates, queries, nodes, beliefs, "default", 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_SUFFIXES_SQL = "{0}"
for _s in resolve.COMPANY_SUFFIXES:
    _SUFFIXES_SQL = f"regexp_replace({_SUFFIXES_SQL}, '{re.escape(_s)}$', '')"
_NORMAL_SQL = f"trim({_SUFFIXES_SQL.format('lower(trim({0}))')})"
_GRAMS_SQL = "list_transform(range(1, length({0}) + 3), lambda i: substr('  ' || {0} || '  ', i, 3))"


@query(
    f"""WITH {NODES_SQL}, {SCORED_SQL}, {ALIASES_SQL}, nd AS (SELECT id, type, label, {_NORMAL_SQL.format("label")} AS norm, salience_score, updated_at FROM scored WHERE type = 'customer'),
    nm AS (SELECT c_custkey AS name_id, CASE c_custkey % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN 'customer:' || c_custkey WHEN 2 THEN 'Cust ' || c_custkey WHEN 3 THEN 'Unknown ' || c_name || ' Inc.' ELSE split_part(c_name, '#', 2) || ' custoner' END AS name, c_custkey % 5 AS k, c_name FROM customer),
    one AS (SELECT name_id, 'customer:' || name_id AS id, 1.0 AS confidence FROM nm WHERE k = 1 UNION ALL SELECT name_id, id, 1.0 FROM nm JOIN nd ON lower(label) = lower(name) WHERE k = 0
      UNION ALL SELECT name_id, node_id, 0.96 FROM nm JOIN aliases ON normalized_alias = lower(name) WHERE k = 2),
    cd AS (SELECT name_id, nd.*, name, {_NORMAL_SQL.format("name")} AS q FROM nm JOIN nd ON label = c_name WHERE k IN (3, 4)),
    g AS (SELECT *, {_GRAMS_SQL.format("q")} AS a, {_GRAMS_SQL.format("norm")} AS b FROM cd),
    s AS (SELECT name_id, id, round(least(greatest(CASE WHEN q = norm THEN 0.97 WHEN contains(q, norm) OR contains(norm, q) THEN 0.88 ELSE 0.84 * 2 * list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) / (len(a) + len(b)) END + 0.06, 0), 1), 9) AS confidence FROM g),
    d AS (SELECT name_id, CASE WHEN confidence >= 0.93 THEN 'match' ELSE 'no_match' END AS status, id, confidence FROM s WHERE confidence >= 0.5 UNION ALL SELECT name_id, 'match', id, confidence FROM one)
    SELECT nm.name_id, coalesce(status, 'no_match') AS status, CASE WHEN status = 'match' THEN id END AS node_id, round(confidence, 6) AS confidence FROM nm LEFT JOIN d USING (name_id)"""
)
def entity_resolution(spark, d):
    """Customers by name in capitals, id, alias, with words before and after, and with the words turned round and one misspelt."""
    name = "CASE c_custkey % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN concat('customer:', c_custkey) WHEN 2 THEN concat('Cust ', c_custkey) WHEN 3 THEN concat('Unknown ', c_name, ' Inc.') ELSE concat(split_part(c_name, '#', 2), ' custoner') END AS name"
    names = table(spark, d, "customer").selectExpr("c_custkey AS name_id", name, "'customer' AS kind")
    found = resolve.resolve(names, _scored(spark, d).where("type = 'customer'"), aliases(spark, d), lookup=True)
    return found.withColumn("confidence", F.round("confidence", 6))


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
    v AS (SELECT doc_id, unnest([CASE WHEN trim(left(t, 300), ' ') = '' THEN 'feedback:query_required' END, CASE WHEN strlen(left(t, 300 + doc_id % 400)) > 500 THEN 'feedback:query_too_long' END, CASE WHEN doc_id % 4 = 3 THEN 'feedback:outcome_unknown' END,
      CASE WHEN doc_id % 6 > 3 THEN 'feedback:too_many_ids' END, CASE WHEN n > 2000 THEN 'request:query_too_long' END, CASE WHEN n > 255 THEN 'request:id_too_long' END, CASE WHEN n = 0 THEN 'request:id_required' END,
      CASE WHEN doc_id % 7 = 0 THEN 'supersede:ids_equal' END, CASE WHEN doc_id % 11 = 0 THEN 'supersede:ids_required' END, CASE WHEN doc_id % 5 = 0 THEN 'episode:ends_before_start' END, CASE WHEN doc_id % 3 = 2 THEN 'episode:status_unknown' END, CASE WHEN trim(left(t, 40), ' ') = '' THEN 'episode:title_required' END]) AS rule FROM d)
    SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1"""
)
def row_violations(spark, d):
    """Feedback, requests, supersessions and episodes made of documents, by the rules that they break."""
    t = F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents").select("doc_id", t.alias("t"))
    k, s = F.col("doc_id"), lambda c: c.cast("string")
    day = lambda n: F.expr(f"timestamp_ntz'2024-01-10 00:00:00' + make_dt_interval({n})")
    feedback = docs.select(
        F.left("t", F.lit(300) + k % 400).alias("query"), F.get(F.array(*map(F.lit, [" Helpful", "unhelpful", "MISSED", "other"])), k % 4).alias("outcome"), F.lit(None).cast("string").alias("note"),
        F.array_repeat(F.lit("x"), (F.lit(17) + k % 6).cast("int")).alias("retrieved"), F.lit(None).cast("array<string>").alias("selected"), F.array().cast("array<string>").alias("expected"),
    )
    parts = {
        "feedback": feedback.select(listing.feedback_violations().alias("v")),
        "request": docs.select(F.col("t").alias("query"), F.col("t").alias("id")).select(listing.request_violations().alias("v")),
        "supersede": docs.select(F.when(k % 11 == 0, "").otherwise(s(k)).alias("old_id"), F.when(k % 7 == 0, F.when(k % 11 == 0, "").otherwise(s(k))).otherwise("other").alias("new_id")).select(listing.supersede_violations().alias("v")),
        "episode": docs.select(s(k).alias("id"), F.left("t", F.lit(40)).alias("title"), F.get(F.array(F.lit("open"), F.lit(""), F.lit("ajar")), k % 3).alias("status"), day(0).alias("started_at"), F.when(k % 5 == 0, day(-1)).otherwise(day(1)).alias("ended_at"), F.lit("{}").alias("properties")).select(listing.episode_violations().alias("v")),
    }
    out = None
    for name, rows in parts.items():
        own = rows.select(F.explode("v").alias("rule")).select(F.concat(F.lit(f"{name}:"), "rule").alias("rule"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT turn AS event_id, conv_id::VARCHAR AS node_id, role FROM conversations WHERE turn = 2")
def event_link_list(spark, d):
    links = table(spark, d, "conversations").selectExpr("turn AS event_id", "CAST(conv_id AS string) AS node_id", "role", "conv_id AS created_at")
    return listing.event_links(links, 2).select("event_id", "node_id", "role")


@query("WITH c AS (SELECT event_type || ':' || user_id AS id, count(*) AS n FROM events GROUP BY 1) SELECT id, n AS count, (SELECT count(*) > 65 FROM c WHERE length(id) % 2 = 0) AS has_more FROM c WHERE length(id) % 2 = 0 ORDER BY n DESC, id LIMIT 50 OFFSET 15")
def unknown_relation_list(spark, d):
    rows = table(spark, d, "events").selectExpr("concat(event_type, ':', user_id) AS id").groupBy("id").agg(F.count("*").alias("count")).withColumn("resolved", F.length("id") % 2 == 1)
    return listing.unknown_relations(rows, False, 50, 15).select("id", "count", "has_more")


@query(
    """WITH c AS (SELECT count(*) FILTER (event_type = 'view') AS parse_failures, count(*) FILTER (event_type = 'purchase') AS api_failures, count(*) FILTER (value < 0) AS ambiguous FROM events)
    SELECT parse_failures, api_failures, ambiguous, array_to_string(list_filter([CASE WHEN parse_failures >= 3 THEN 'parse_failures' END, CASE WHEN api_failures >= 1000000000 THEN 'api_failures' END, CASE WHEN ambiguous >= 0 THEN 'ambiguous' END], lambda x: x IS NOT NULL), ',') AS alerts FROM c"""
)
def ingest_alerts(spark, d):
    is_ = lambda kind: F.count_if(F.col("event_type") == kind)
    counters = table(spark, d, "events").agg(is_("view").alias("parse_failures"), is_("purchase").alias("api_failures"), F.count_if(F.col("value") < 0).alias("ambiguous"))
    return aggregates.diagnostic_alerts(counters, {"parse_failures": 3, "api_failures": 1_000_000_000, "ambiguous": 0}).withColumn("alerts", F.array_join("alerts", ","))


_FOUND_SQL = "e AS (SELECT DISTINCT user_id AS doc, event_type || event_id % 5 AS name FROM events WHERE event_id % 3 <> 0), f AS (SELECT DISTINCT user_id AS doc, event_type || event_id % 5 AS name FROM events WHERE event_id % 4 <> 0)"


@query(
    f"""WITH {_FOUND_SQL}, b AS (SELECT coalesce(e.doc, f.doc) AS doc, count(e.name) AS n_expected, count(f.name) AS n_found, count(e.name || f.name) AS n_hit FROM e FULL JOIN f ON e.doc = f.doc AND e.name = f.name GROUP BY 1)
    SELECT doc, n_expected, n_found, n_hit, round(coalesce(n_hit / nullif(n_found, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(n_hit / nullif(n_expected, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2.0 * n_hit / nullif(n_found + n_expected, 0), 0), 6) AS f1 FROM b"""
)
def extraction_benchmark(spark, d):
    """Names that each user's events should have given and did give."""
    rows = table(spark, d, "events").selectExpr("user_id AS doc", "concat(event_type, event_id % 5) AS name", "event_id")
    got = aggregates.extraction_scores(rows.where("event_id % 3 <> 0"), rows.where("event_id % 4 <> 0"), ["name"])
    return got.select("doc", "n_expected", "n_found", "n_hit", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH m AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^$', '') AS line FROM conversations),
    q AS (SELECT conv_id, arg_min(text, turn) AS text, [CASE WHEN conv_id % 3 = 0 THEN 'Task  ' || conv_id END] AS work, CASE WHEN conv_id % 2 = 0 THEN ['Nora', 'nora ', 'Quill ' || conv_id] ELSE [] END AS ent FROM conversations GROUP BY 1),
    p AS (SELECT q.conv_id, q.text, left(line, {session.ITEM_CHARS}) AS msg FROM q LEFT JOIN (SELECT conv_id, arg_max(line, turn) AS line FROM m WHERE line <> '' GROUP BY 1) l USING (conv_id)),
    c AS (SELECT conv_id, lower(p.text) AS low, p.text, CASE WHEN conv_id % 3 = 0 THEN 'Task ' || conv_id END AS work, CASE WHEN conv_id % 2 = 0 THEN 'Nora Quill ' || conv_id END AS ent, msg FROM p),
    v AS (SELECT *, list_filter(list_transform([text, text || ' ' || ent, text || ' ' || work, text || ' ' || msg], lambda x: left(trim(regexp_replace(x, '\\s+', ' ', 'g')), {session.FORM_CHARS})), lambda x: x IS NOT NULL AND x <> '') AS f,
      regexp_matches(low, '{session.FILE_WORDS}') OR work IS NOT NULL AS files, regexp_matches(low, '{session.GRAPH_WORDS}') OR ent IS NOT NULL AS graph FROM c)
    SELECT conv_id AS query_id, CASE WHEN files AND NOT graph THEN 'file' WHEN graph AND NOT files THEN 'graph' ELSE 'both' END AS source, array_to_string(list_filter(f, lambda x, i: len(list_filter(f[1:i - 1], lambda y: lower(y) = lower(x))) = 0), '|') AS forms FROM v"""
)
def session_contexts(spark, d):
    """Each conversation's first turn as a question, with its last turn, a task and names as context."""
    c = table(spark, d, "conversations")
    rows = c.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("text"), F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("t"), "text"))).alias("m"))
    task = F.when(F.col("query_id") % 3 == 0, F.array(F.concat(F.lit("Task  "), F.col("query_id").cast("string"))))
    names = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("Nora"), F.lit("nora "), F.concat(F.lit("Quill "), F.col("query_id").cast("string"))))
    found = session.retrieval_context(rows.select("query_id", "text", names.alias("entities"), F.col("m.text").alias("messages"), task.alias("work")))
    return found.select("query_id", "source", F.array_join("forms", "|").alias("forms"))


@query(
    """WITH h AS (SELECT user_id AS query_id, CASE event_type WHEN 'view' THEN 'file' ELSE 'graph' END AS source, (event_id % 97)::VARCHAR AS key, max(value) AS score FROM events GROUP BY 1, 2, 3),
    b AS (SELECT query_id, key, max({'score': score * CASE source WHEN 'file' THEN 0.8 ELSE 1.0 END, 'source': source}) AS b FROM h GROUP BY 1, 2),
    r AS (SELECT query_id, key, b.source AS source, round(b.score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(b.score, 9) DESC, key) AS rank FROM b WHERE round(b.score, 9) >= 20)
    SELECT *, CASE source WHEN 'file' THEN 'file-memory match' ELSE 'knowledge-graph match' END AS why FROM r WHERE rank <= 5"""
)
def unified_results(spark, d):
    """Hits of files and of the graph over several forms of each question, as one list."""
    hits = table(spark, d, "events").selectExpr("user_id AS query_id", "event_id AS form", "CASE event_type WHEN 'view' THEN 'file' ELSE 'graph' END AS source", "CAST(event_id % 97 AS string) AS key", "value AS score")
    merged = rank.merge_results(session.best_of_forms(hits).withColumn("intent", F.lit("general")), {"file": 0.8}, {}, limit=1000)
    found = session.unified(merged, 20.0, 5)
    return found.select("query_id", "key", "source", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "why")
