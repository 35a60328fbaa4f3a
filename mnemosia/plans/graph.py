"""A knowledge graph over the driver's tables, as DataFrames and as SQL.

Nodes are regions, nations, customers, suppliers, parts and orders; edges follow
the foreign keys. Every table is a plain scan, projection or grouped join, so
queries on it keep filters and columns at the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-09-01"
_CREATED = "timestamp_ntz'1992-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, kind: str, key: str, label: str, properties: str, accesses: str = "0", last: str = "CAST(NULL AS timestamp_ntz)", boosted: str = "false", superseded: str = "CAST(NULL AS string)") -> DataFrame:
    created = f"{_CREATED} + make_dt_interval(CAST({key} % 1000 AS int))"
    return df.selectExpr(
        f"concat('{kind}:', {key}) AS id", f"'{kind}' AS type", f"{label} AS label", f"{properties} AS properties",
        f"CAST({accesses} AS bigint) AS access_count", f"{last} AS last_accessed", f"{boosted} AS user_boosted", f"{superseded} AS superseded_by",
        f"{created} AS created_at", f"coalesce({last}, {created}) AS updated_at",
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, label, properties (JSON), access_count, last_accessed, user_boosted, superseded_by, created_at, updated_at."""
    t = lambda name: table(spark, sf_dir, name)
    use = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    customers = t("customer").join(use, "c_custkey", "left")
    parts = [
        _node(t("region"), "region", "r_regionkey", "r_name", "'{}'"),
        _node(t("nation"), "nation", "n_nationkey", "n_name", "concat('{\"region_id\":\"', n_regionkey, '\"}')"),
        _node(customers, "customer", "c_custkey", "c_name", "concat('{\"segment\":\"', c_mktsegment, '\",\"nation_id\":\"', c_nationkey, '\"}')", "coalesce(n, 0)", "last", "c_acctbal > 9000", "CASE WHEN c_custkey % 50 = 0 THEN concat('customer:', c_custkey - 1) END"),
        _node(t("supplier"), "supplier", "s_suppkey", "s_name", "concat('{\"nation_id\":\"', s_nationkey, '\"}')", boosted="s_acctbal > 9000"),
        _node(t("part"), "part", "p_partkey", "p_name", "concat('{\"brand\":\"', p_brand, '\",\"type\":\"', p_type, '\",\"size\":\"', p_size, '\"}')"),
        _node(t("orders"), "order", "o_orderkey", "concat('Order ', o_orderkey)", "concat('{\"status\":\"', o_orderstatus, '\",\"priority\":\"', o_orderpriority, '\"}')", last="o_orderdate"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relation, weight, date_lower, date_upper, is_current, created_at."""
    t = lambda name: table(spark, sf_dir, name)
    none = "CAST(NULL AS date)"
    edge = lambda df, s, o, r, w="1.0D", lo=none, hi=none, cur="true": df.selectExpr(f"{s} AS source", f"{o} AS target", f"'{r}' AS relation", f"{w} AS weight", f"{lo} AS date_lower", f"{hi} AS date_upper", f"{cur} AS is_current")
    uses = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    made = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = [
        edge(t("nation"), "concat('nation:', n_nationkey)", "concat('region:', n_regionkey)", "part_of"),
        edge(t("customer"), "concat('customer:', c_custkey)", "concat('nation:', c_nationkey)", "located_in"),
        edge(t("supplier"), "concat('supplier:', s_suppkey)", "concat('nation:', s_nationkey)", "located_in"),
        edge(t("orders"), "concat('customer:', o_custkey)", "concat('order:', o_orderkey)", "created", lo="CAST(o_orderdate AS date)", cur="CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END"),
        edge(uses, "concat('order:', l_orderkey)", "concat('part:', l_partkey)", "uses", "CAST(q AS double)", "CAST(lo AS date)", "CAST(hi AS date)", "CAST(NULL AS boolean)"),
        edge(made, "concat('part:', l_partkey)", "concat('supplier:', l_suppkey)", "product_of"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, alias, normalized_alias, alias_type, confidence: part brands as aliases of parts, and short names of customers."""
    p = table(spark, sf_dir, "part").selectExpr("concat('part:', p_partkey) AS node_id", "concat(p_brand, '  ', p_size) AS alias", "'brand' AS alias_type", "0.5D AS confidence")
    c = table(spark, sf_dir, "customer").selectExpr("concat('customer:', c_custkey) AS node_id", "concat(' Cust ', c_custkey, ' ') AS alias", "'short' AS alias_type", "1.0D AS confidence")
    from mnemosia.functions.text import normalize_alias

    return p.unionByName(c).select("node_id", "alias", normalize_alias(F.col("alias")).alias("normalized_alias"), "alias_type", "confidence")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, embedding."""
    return table(spark, sf_dir, "embeddings").selectExpr("concat('customer:', vec_id) AS id", "vec_id", "label", "embedding")


def _sql_node(frm: str, kind: str, key: str, label: str, properties: str, accesses: str = "0", last: str = "CAST(NULL AS TIMESTAMP)", boosted: str = "false", superseded: str = "CAST(NULL AS VARCHAR)") -> str:
    created = f"TIMESTAMP '1992-01-01' + to_days(({key} % 1000)::INTEGER)"
    return (
        f"SELECT '{kind}:' || {key} AS id, '{kind}' AS type, {label} AS label, {properties} AS properties, ({accesses})::BIGINT AS access_count, {last} AS last_accessed, "
        f"{boosted} AS user_boosted, {superseded} AS superseded_by, {created} AS created_at, coalesce({last}, {created}) AS updated_at FROM {frm}"
    )


NODES_SQL = "nodes AS (" + " UNION ALL ".join(
    [
        _sql_node("region", "region", "r_regionkey", "r_name", "'{}'"),
        _sql_node("nation", "nation", "n_nationkey", "n_name", "'{\"region_id\":\"' || n_regionkey || '\"}'"),
        _sql_node("customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1) u ON o_custkey = c_custkey", "customer", "c_custkey", "c_name", "'{\"segment\":\"' || c_mktsegment || '\",\"nation_id\":\"' || c_nationkey || '\"}'", "coalesce(n, 0)", "last", "c_acctbal > 9000", "CASE WHEN c_custkey % 50 = 0 THEN 'customer:' || (c_custkey - 1) END"),
        _sql_node("supplier", "supplier", "s_suppkey", "s_name", "'{\"nation_id\":\"' || s_nationkey || '\"}'", boosted="s_acctbal > 9000"),
        _sql_node("part", "part", "p_partkey", "p_name", "'{\"brand\":\"' || p_brand || '\",\"type\":\"' || p_type || '\",\"size\":\"' || p_size || '\"}'"),
        _sql_node("orders", "order", "o_orderkey", "'Order ' || o_orderkey", "'{\"status\":\"' || o_orderstatus || '\",\"priority\":\"' || o_orderpriority || '\"}'", last="o_orderdate"),
    ]
) + ")"

_N = "CAST(NULL AS DATE)"
EDGES_SQL = f"""edges AS (
SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'part_of' AS relation, 1.0::DOUBLE AS weight, {_N} AS date_lower, {_N} AS date_upper, true AS is_current FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 1.0, {_N}, {_N}, true FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 1.0, {_N}, {_N}, true FROM supplier
UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'created', 1.0, o_orderdate::DATE, {_N}, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END FROM orders
UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'uses', sum(l_quantity), min(l_shipdate)::DATE, max(l_shipdate)::DATE, NULL FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'product_of', 1.0, {_N}, {_N}, true FROM lineitem)"""

ALIASES_SQL = """aliases AS (
SELECT 'part:' || p_partkey AS node_id, p_brand || '  ' || p_size AS alias, regexp_replace(lower(trim(p_brand || '  ' || p_size)), '\\s+', ' ', 'g') AS normalized_alias, 'brand' AS alias_type, 0.5::DOUBLE AS confidence FROM part
UNION ALL SELECT 'customer:' || c_custkey, ' Cust ' || c_custkey || ' ', 'cust ' || c_custkey, 'short', 1.0 FROM customer)"""

#: Salience of a node as of AS_OF (see operators.salience).
SALIENCE_SQL = f"""greatest(0.1, 1.0 + 0.3 * log2(access_count + 1) + 0.5 * greatest(0.0, 1.0 - (epoch(TIMESTAMP '{AS_OF}') - epoch(coalesce(last_accessed, created_at))) / 86400.0 / 180.0)
  + CASE WHEN user_boosted THEN 2.0 ELSE 0.0 END - CASE WHEN superseded_by IS NOT NULL THEN 0.5 ELSE 0.0 END)"""
SCORED_SQL = f"scored AS (SELECT *, round({SALIENCE_SQL}, 6) AS salience_score FROM nodes)"
