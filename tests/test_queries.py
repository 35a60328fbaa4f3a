"""A few queries against DuckDB at the smallest size, and the driver's entry points."""

import os

import duckdb
import pytest

import __spark_entry__
from mnemosia.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


ROUND = "document_compaction edge_orientation property_merge postings_search intent_shaping service_rerank failure_ledger import_graph row_violations change_feed relationship_writes ingest_report entity_resolution canonical_properties".split()


def rows(frame):
    return sorted(repr([round(float(v), 6) if isinstance(v, float) else str(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["hybrid_search", "list_nodes", "node_by_label", "fact_beliefs", "duplicate_pairs", "traverse", "recent_episodes", "evaluation_report", "change_buffer", *ROUND])
def test_against_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query_id", "id", "rrf", "score", "rank"]
