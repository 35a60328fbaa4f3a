"""op13: against a plain-Python version and SQL."""

import re
from collections import Counter

import duckdb
import pytest

from mnemosia.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, `_id` long, `lang.x` string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs):
    """All terms of all groups, one by one."""
    rows = [(t or "", l or "", s or "") for _, t, l, s, *_ in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)) for t, _, _ in rows]
    out = []
    for lang in {l for _, l, _ in rows}:
        own = [(w, s) for w, (_, l, s) in zip(words, rows) if l == lang]
        df = Counter(t for w, _ in own for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        groups = {s: Counter(t for w, s2 in own if s2 == s for t in w) for s in {s for _, s in own}}
        every = sum(groups.values(), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(every)
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            over = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)] + [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(over[:50])]
    return sorted(out)


def result(df, min_docs):
    groups, postings, shared = divergence.audit(df, min_docs)
    pairs = [(r.lang, r.source, r.other, r.value) for r in divergence.pair_divergences(groups, postings).collect()]
    terms = [(r.lang, r.source, "term", r.term, r.value, r.rank) for r in divergence.term_excesses(postings, shared).collect()]
    out = list(terms)
    for lang, source in {(r[0], r[1]) for r in pairs}:
        own = sorted((-v, o.encode(), o) for l, s, o, v in pairs if (l, s) == (lang, source))
        out += [(lang, source, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(own)]
    return sorted(out)


ROWS = [
    (1, "Ab ab c É é Éa", "en", "a", 1, "x"), (2, "ab c d1e \x00 C", "en", "b", 1, "x"), (2, "ab c d1e \x00 C", "en", "b", 1, "x"), (3, None, "en", "c", 1, None),
    (4, "", "en", None, 1, "x"), (5, "ab", None, None, 1, "x"), (None, "12 34", "fr", "a", 1, "x"), (6, "lone", "fr", "b", 1, "x"),
    (7, "ab zz " * 3000 + "É" * 2000, "en", "a", 1, "x"), (8, "zz é ab", "en", "d", None, "x"), (9, "È é é ß ab zz", "en", "e", 1, "x"),
]


@pytest.mark.parametrize("min_docs", [1, 2, 3, 50])
def test_against_brute_force(spark, min_docs):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert result(df, min_docs) == brute(ROWS, min_docs)


def test_many_sources(spark):
    rows = [(i, " ".join(f"w{chr(97 + (i * k * k) % 13)}" for k in range(1, 9 + i % 5)), "de", f"s{i % 9 if i % 3 else 0}", 0, "") for i in range(240)]
    assert result(spark.createDataFrame(rows, SCHEMA), 30) == brute(rows, 30)


def test_empty(spark):
    assert result(spark.createDataFrame([], SCHEMA), 1) == []


def test_blocks_of_texts_add_up(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    whole = result(docs, 2)
    monkeypatch.setattr(divergence, "HELD_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert result(docs, 2) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    got = divergence.op13_source_divergence(spark, sf).select(columns).toPandas().values.tolist()
    assert sorted(got) == sorted(duck.sql(divergence.ORACLE).df()[columns].values.tolist())
