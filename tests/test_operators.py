import pytest
from pyspark.sql import functions as F

from mnemosia.operators import duplicates, facts, graph, ingest, listing, recall, resolve, upsert
from mnemosia.sources import files
from mnemosia.streaming import feed


def nodes_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def edges_of(spark, *pairs):
    return spark.createDataFrame([(a, b, "uses", 1.0) for a, b in pairs], "source string, target string, relation string, weight double")


def test_star_is_capped(spark):
    leaves = [f"n{i:03d}" for i in range(600)]
    n, e = nodes_of(spark, "root", *leaves), edges_of(spark, *[("root", x) for x in leaves])
    found, inner = graph.traverse(n, e, "root", 1)
    ids = {r.id for r in found.collect()}
    assert len(ids) == 500 and "root" in ids
    assert all(r.source in ids and r.target in ids for r in inner.collect())


def test_paths(spark):
    n, e = nodes_of(spark, "a", "b", "c", "d", "z"), edges_of(spark, ("a", "b"), ("c", "b"), ("c", "d"), ("a", "a"))
    assert [r.id for r in graph.shortest_path(n, e, "a", "d").orderBy("place").collect()] == ["a", "b", "c", "d"]
    assert graph.shortest_path(n, e, "a", "z").count() == 0
    assert [r.id for r in graph.shortest_path(n, e, "a", "a").collect()] == ["a"]
    with pytest.raises(listing.NotFound):
        graph.shortest_path(n, e, "a", "nope")
    assert graph.neighbor_edges(e, "a").count() == 3  # the self-loop comes twice
    assert [r.id for r in graph.neighbors(n, e, "a")[0].collect()] == ["b"]


def test_contested_and_conflicts(spark):
    rows = [("n", "city", '"Austin"', "s", "2024-01-01", 0.9), ("n", "city", '"Chicago"', "s", "2024-01-02", 0.9), ("n", "city", '"Austin"', "s", "2024-01-03", 0.9), ("n", "city", '"Chicago"', "s", "2024-01-04", 0.9)]
    ev = spark.createDataFrame(rows, "node_id string, property string, value string, source string, ts string, confidence double")
    cur = spark.createDataFrame([("n", "city", '"Chicago"')], "node_id string, property string, value string")
    b = facts.beliefs(ev, cur).first()
    assert (b.status, b.preferred_value, b.evidence_count) == ("contested", '"Chicago"', 4)
    assert {r.status for r in facts.claims(ev, cur).collect()} == {"contested"}
    up = spark.createDataFrame([("n", "city", '"Austin"', "s", "t", 0.82)], ev.schema)
    new, evidence = facts.consolidate(cur, up)
    e = evidence.first()
    assert new.first().value == '"Austin"' and e.conflicts_with_prior and e.previous_value == '"Chicago"'
    assert not facts.consolidate(cur, up.withColumn("value", F.lit('"Chicago"')))[1].first().conflicts_with_prior
    assert facts.beliefs(ev, cur.where("false")).first().status == "superseded"


def test_patch(spark):
    row = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "null", "c": "3"})], "o map<string,string>, p map<string,string>")
    assert row.select(facts.merge_properties(F.col("o"), F.col("p")).alias("m")).first().m == {"a": "1", "c": "3"}


def test_suggestions(spark):
    n = spark.createDataFrame(
        [("node-a", "person", "Ann Lee", 9.0, None, '{"email":"A@x.org"}'), ("node-b", "person", "ann  lee", 1.0, None, '{"email":"a@x.org "}'), ("c", "company", "Ann Lee", 1.0, None, "{}"), ("d", "person", "Ann Lee", 1.0, "node-a", "{}")],
        "id string, type string, label string, salience_score double, superseded_by string, properties string",
    )
    a = spark.createDataFrame([], "node_id string, normalized_alias string")
    got = duplicates.merge_suggestions(n, duplicates.duplicate_pairs(n, a)).collect()
    assert [(r.canonical_id, r.duplicate_id, r.score) for r in got] == [("node-a", "node-b", 0.9)]


def test_resolution(spark):
    n = spark.createDataFrame([("p1", "person", "Bill Gates"), ("p2", "company", "Acme"), ("p3", "company", "Acme, Inc.")], "id string, type string, label string")
    a = spark.createDataFrame([("p1", "william gates")], "node_id string, normalized_alias string")
    names = spark.createDataFrame([(1, "bill gates", "person"), (2, "Acme", "company"), (3, "Nobody", ""), (4, "p1", "")], "name_id int, name string, kind string")
    got = {r.name_id: (r.status, r.node_id) for r in resolve.resolve(names, n, a).collect()}
    assert got == {1: ("match", "p1"), 2: ("ambiguous", None), 3: ("no_match", None), 4: ("match", "p1")}


def test_upserts(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, label string, created int")
    new = spark.createDataFrame([("b", "Y"), ("c", "Z")], "id string, label string")
    t, acts = upsert.upsert(old, new, ["id"], ["label"])
    assert sorted(map(tuple, t.collect())) == [("a", "x", 1), ("b", "Y", 2), ("c", "Z", None)]
    assert sorted(map(tuple, acts.collect())) == [("b", "updated"), ("c", "created")]
    again, _ = upsert.upsert(t, new, ["id"], ["label"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, t.collect()))
    assert sorted(map(tuple, upsert.upsert(old, new, ["id"], ["label"], overwrite=False)[0].collect())) == [("a", "x", 1), ("b", "y", 2), ("c", "Z", None)]
    with pytest.raises(LookupError):
        upsert.upsert_edges(old, edges_of(spark), edges_of(spark, ("a", "q")))
    with pytest.raises(ValueError, match="duplicate"):
        upsert.insert_new(old, old, ["id"])


def test_finalize(spark):
    ents = spark.createDataFrame([("d", 1, "Ann Lee", "Person"), ("d", 2, "ann", "person"), ("d", 3, "Acme Inc.", "organization"), ("d", 4, "acme", "company"), ("d", 5, "trust", "concept"), ("d", 6, "Rocket", "app")], "doc string, seq int, name string, type string")
    rels = spark.createDataFrame([("d", 1, "Ann", "Acme", "employed_at", False), ("d", 2, "Ann Lee", "Rocket", "belongs_to", None), ("d", 3, "Ann", "Ann Lee", "uses", None), ("d", 4, "ann lee", "acme inc.", "works_at", False)], "doc string, seq int, source string, target string, relation string, is_current boolean")
    fs = spark.createDataFrame([("d", 1, "ann", "Location", "x"), ("d", 2, "Ann Lee", "residence", "y"), ("d", 3, "trust", "k", "v")], "doc string, seq int, subject string, property string, value string")
    e, r, f = ingest.finalize(ents, rels, fs)
    assert "Rocket" in {x.name for x in e.collect()} and "trust" not in {x.name for x in e.collect()}
    # "ann" has a name of its own, so that row is not one of a person with themself
    assert {(x.source, x.relation, x.target) for x in r.collect()} == {("ann", "worked_at", "acme"), ("Ann Lee", "created", "Rocket"), ("ann", "uses", "Ann Lee"), ("Ann Lee", "worked_at", "Acme Inc.")}
    assert {(x.subject, x.property, x.value) for x in f.collect()} == {("ann", "residence", "x"), ("Ann Lee", "residence", "y")}


def test_recall_sections(spark):
    ev = spark.createDataFrame(
        [("e1", "p", "decision", "t", '{"status":" Open "}', 1.0, "2024-01-01 00:00:00"), ("e2", "p", "outcome", "t", "{}", 1.0, "2024-01-03 00:00:00"), ("e3", None, "task", "t", '{"state":"done"}', 1.0, "2024-01-02 00:00:00")],
        "id string, episode_id string, kind string, title string, properties string, confidence double, at string",
    ).select("id", "episode_id", "kind", "title", "properties", "confidence", F.col("at").cast("timestamp_ntz").alias("occurred_at"), F.lit(None).cast("timestamp_ntz").alias("occurred_start_at"), F.lit(None).cast("timestamp_ntz").alias("occurred_end_at"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    links = spark.createDataFrame([("e1", "a", "x"), ("e2", "a", "y"), ("e3", "a", "x"), ("e3", "b", "x")], "event_id string, node_id string, role string")
    eps = spark.createDataFrame([("p", "P", "closed")], "id string, title string, status string")
    c = recall.event_contexts(ev, links, eps, nodes_of(spark, "a", "a"))
    assert [r.id for r in recall.open_decisions(c).collect()] == ["e1"]
    got = recall.recent_episodes(c).collect()
    assert [(r.key, r.n_events, r.latest_outcome) for r in got] == [("p", 2, "e2"), ("event:e3", 1, None)]
    assert {r.id: r.linked_ids for r in c.collect()}["e3"] == ["a"]


def test_feed(spark, tmp_path):
    rows = [(i, "t" if i % 2 else "u", None, f"2024-01-01 00:00:{i:02d}", "{}") for i in range(10)] + [(99, None, "x", "2024-01-01 00:00:00", "{}"), (98, "t", "x", "2024-01-01 00:00:00", "z" * 5000)]
    changes = spark.createDataFrame(rows, "change_id long, tenant string, type string, ts string, payload string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    buf = feed.buffered(changes, "2024-01-01 00:10:00", size=3)
    got, reset = feed.replay(buf, "t", 4)
    assert [r.seq for r in got.collect()] == [5] and not reset
    assert feed.replay(buf, "t", 1)[1]
    feed.publish(changes, f"{tmp_path}/changes")
    seen = []
    q = feed.subscribe(spark, f"{tmp_path}/changes", f"{tmp_path}/cp", lambda df, _: seen.extend(r.change_id for r in df.collect()), tenant="t", once=True)
    q.awaitTermination()
    assert sorted(seen) == [1, 3, 5, 7, 9]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# a")
    first = files.changed_files(spark, str(tmp_path), None)
    manifest = spark.createDataFrame(first.select("path", "length", "modificationTime").collect(), first.select("path", "length", "modificationTime").schema)
    assert first.count() == 1 and files.changed_files(spark, str(tmp_path), manifest).count() == 0
    c = files.Catalog(spark, f"{tmp_path}/cat", "t1")
    c.append("nodes", nodes_of(spark, "a", "b"))
    files.Catalog(spark, f"{tmp_path}/cat", "t2").append("nodes", nodes_of(spark, "z"))
    assert {r.id for r in c.table("nodes").collect()} == {"a", "b"}
    got = files.embed(spark.createDataFrame([("a", "xy")], "id string, text string"), lambda texts: [[float(len(t))] for t in texts])
    assert got.first().embedding == [2.0]


def test_paging(spark):
    rows = spark.range(5).selectExpr("CAST(id AS string) AS id", "'t' AS type", "1.0D AS salience_score", "1 AS updated_at")
    got = listing.list_nodes(rows, limit=2, offset=1).collect()
    assert [(r.id, r.has_more) for r in got] == [("1", True), ("2", True)]
    assert [r.has_more for r in listing.list_nodes(rows, limit=2, offset=3).collect()] == [False, False]
    with pytest.raises(ValueError, match="offset"):
        listing.list_nodes(rows, offset=-1)


def test_a_path_through_many_nodes(spark):
    """More nodes than any level's limit: the way back is found whatever the size of the levels."""
    rows = [("root", f"h{i}") for i in range(60)] + [(f"h{i}", f"l{i}_{k}") for i in range(60) for k in range(400)]
    e = edges_of(spark, *rows)
    n = nodes_of(spark, "root", *[b for _, b in rows])
    for leaf in ("l0_0", "l59_399", "l30_200"):
        assert [r.id for r in graph.shortest_path(n, e, "root", leaf).orderBy("place").collect()] == ["root", "h" + leaf[1:].split("_")[0], leaf]
    assert graph.traverse_levels(e, ["root"], 2, cap=None).count() == 1 + 60 + 60 * 400


def test_without_a_cap_every_edge_is_followed(spark):
    e = spark.range(1200).selectExpr("concat('leaf:', id) AS source", "'root' AS target", "'uses' AS relation")
    assert graph.traverse_levels(e, ["root"], 1, cap=None).count() == 1201
    assert graph.traverse_levels(e, ["leaf:1"], 2, cap=None).where("hop = 2").count() == 1199


def test_a_gap_of_the_least_margin_is_not_contested(spark):
    """0.45 and 0.3 are 0.15 apart, whatever the order in which the means are added up."""
    for first in ([0.8, 0.1], [0.1, 0.8], [0.9, 0.1, 0.3, 0.5], [0.5, 0.3, 0.1, 0.9]):
        ev = spark.createDataFrame([("n", "p", "a", "s", "t", c) for c in first] + [("n", "p", "b", "s", "t", c) for c in (0.2, 0.3, 0.4)], "node_id string, property string, value string, source string, ts string, confidence double")
        mean = sum(first) / len(first)
        assert facts.beliefs(ev.coalesce(1), spark.createDataFrame([("n", "p", "a")], "node_id string, property string, value string")).first().status == "supported", mean
    ev = spark.createDataFrame([("n", "p", "a", "s", "t", 0.6), ("n", "p", "b", "s", "t", 0.45)], ev.schema)
    assert facts.beliefs(ev, spark.createDataFrame([("n", "p", "a")], "node_id string, property string, value string")).first().status == "supported"


def test_nearest_vectors_by_blocks(spark, monkeypatch):
    """Copies, ties, other lengths, zeros, nulls and huge values, over several blocks of both sides, against every pair."""
    import random

    from mnemosia.operators import search

    for name in ("VECTOR_ROWS", "QUERY_ROWS", "QUERY_CHUNK", "PAIRS"):
        monkeypatch.setattr(search, name, 7)
    rng = random.Random(3)
    rows = [(f"v{k:03}", [rng.choice([0.0, 1.0, -2.0, rng.random()]) for _ in range(3)]) for k in range(60)] + [(f"w{k:02}", [1.0, 2.0, 3.0]) for k in range(20)]
    rows += [("x1", [1e200, 1.0, 1.0]), ("x2", [1.0, 2.0]), ("x3", [0.0, 0.0, 0.0]), ("x4", [None, 1.0, 1.0]), ("x5", None), ("x6", [])]
    v = spark.createDataFrame(rows, "id string, embedding array<double>")
    q = spark.createDataFrame([(k, rows[n][1]) for k, n in enumerate([0, 3, 5, 8, 13, 21, 34, 55, 60, 61, 81, 84])], "query_id int, embedding array<double>")
    expected = set()
    for query in q.collect():
        scored = []
        for id_, e in rows:
            if not e or not query.embedding or len(e) != len(query.embedding) or None in e or not any(e) or not any(query.embedding):
                continue
            dot = lambda a, b: sum((x * y for x, y in zip(a, b)), 0.0)
            below = dot(e, e) ** 0.5 * dot(query.embedding, query.embedding) ** 0.5
            scored.append((-round(dot(e, query.embedding) / below, 6), id_))
        expected |= {(query.query_id, id_, -score, n + 1) for n, (score, id_) in enumerate(sorted(scored)[:4])}
    got = search.semantic(v, q, 4)
    assert {(r.query_id, r.id, r.score + 0.0, r["rank"]) for r in got.collect()} == expected
    assert "Nested" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_common_first_word_loses_no_candidate(spark):
    n = spark.createDataFrame([(f"p{i}", "company", f"Acme number {i} of many") for i in range(1500)], "id string, type string, label string")
    names = spark.createDataFrame([(1, "acme number 700 of manny", "company")], "name_id int, name string, kind string")
    got = resolve.resolve(names, n, spark.createDataFrame([], "node_id string, normalized_alias string")).first()
    assert got.status != "no_match" and got.confidence > 0.5


def test_every_known_name_counts(spark):
    ents = spark.createDataFrame([("d", 1, "Zed", "person")], "doc string, seq int, name string, type string")
    known = spark.createDataFrame([(f"P{i} Last",) for i in range(200)] + [("Zoe Last",)], "name string")
    mentioned = spark.createDataFrame([("d", "zoe"), ("d", "p150"), ("d", "zed")], "doc string, low string")
    got = {r.low: r.canonical for r in ingest.canonical_names(ents, known, mentioned).collect()}
    assert got == {"zed": "Zed", "zoe": "Zoe Last", "p150": "P150 Last"}


def test_zero_vectors_and_missing_counts(spark):
    from mnemosia.operators import rank, search

    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0]), ("c", None), ("d", [1.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 2.0]), (2, [0.0, 0.0])], "query_id int, embedding array<double>")
    assert [(r.query_id, r.id, r.score) for r in search.semantic(v, q).collect()] == [(1, "b", 1.0)]
    c = spark.createDataFrame([(1, "x", 1)], "query_id int, id string, rank int")
    b = spark.createDataFrame([("x", "supported", None, None, None, None)], "id string, status string, evidence_count int, preferred_confidence double, matches_current boolean, last_observed timestamp_ntz")
    assert rank.belief_score(c, b).first().belief == pytest.approx(0.67)


def test_hybrid_service(spark):
    from mnemosia.operators import service

    n = spark.createDataFrame([("a", "Oslo Harbour", "oslo harbour cranes", 1.0, 1), ("b", "Bergen", "bergen rain", 2.0, 1), ("c", "Crane", "crane maker", 0.2, 1)], "id string, label string, search_text string, salience_score double, updated_at int")
    n = n.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    al = spark.createDataFrame([("b", "Rainy City", "rainy city")], "node_id string, alias string, normalized_alias string")
    e = edges_of(spark, ("a", "c"))
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, "Who is Rainy City?"), (2, "oslo harbour"), (3, "nothing")], "query_id int, text string")
    emb = spark.createDataFrame([("who is rainy city", [1.0, 0.1])], "text string, embedding array<double>")
    got = {}
    for r in service.hybrid_service(n, al, e, v, q, emb, limit=3, stemmed=False).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {1: ["b", "c", "a"], 2: ["a", "c"]}
    full = service.full_text_service(n, al, e, q, limit=2, stemmed=False).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in full] == [(1, "b"), (2, "a"), (2, "c")]
    least = {r.query_id: r.least for r in service.least_salience(spark.createDataFrame([(1, "how to sail"), (2, "history of rain"), (3, "rain")], "query_id int, text string")).collect()}
    assert least == {1: 1.0, 2: 0.5, 3: 0.0}


def test_the_first_pairs_are_those_of_all_pairs(spark):
    """Against sorting every pair: a name of very many nodes, ties of salience, several names."""
    import random

    rng = random.Random(3)
    rows = [(f"n{i:03d}", rng.choice("ab"), rng.choice(["X", "X", "Y", f"z{i}"]), float(rng.randrange(4)), None) for i in range(120)]
    alias = [(f"n{rng.randrange(120):03d}", rng.choice(["x", "y", "w"])) for _ in range(60)]
    n = spark.createDataFrame(rows, "id string, type string, label string, salience_score double, superseded_by string")
    a = spark.createDataFrame(alias, "node_id string, normalized_alias string")
    names = {r[0]: {r[2].lower(): True} for r in rows}
    for i, x in alias:
        names[i].setdefault(x, False)
    every = []
    for p in rows:
        for q in rows:
            both = sorted(names[p[0]].keys() & names[q[0]].keys())
            if p[0] < q[0] and p[1] == q[1] and both:
                every.append((not any(names[p[0]][x] and names[q[0]][x] for x in both), -len(both), -max(p[3], q[3]), p[0], q[0], tuple(both)))
    for limit in (1, 5, 40, 10_000):
        got = [(r.left_id, r.right_id, tuple(r.shared_names)) for r in duplicates.duplicate_pairs(n, a, limit=limit).collect()]
        assert got == [x[3:] for x in sorted(every)[:limit]]
    assert duplicates.duplicate_classes(n, a)[1].agg(F.sum("n_pairs")).first()[0] == len(every)


def test_single_rows(spark):
    n = nodes_of(spark, "a", "b")
    e = edges_of(spark, ("a", "b"))
    e = upsert.create_edge(n, e, spark.createDataFrame([("b", "a", "uses", None)], e.schema))
    assert sorted((r.source, r.weight) for r in e.collect()) == [("a", 1.0), ("b", 1.0)]
    with pytest.raises(LookupError):
        upsert.create_edge(n, e, edges_of(spark, ("a", "z")))
    with pytest.raises(ValueError, match="duplicate"):
        upsert.create_edge(n, e, edges_of(spark, ("a", "b")))
    key = {"source": "a", "target": "b", "relation": "uses"}
    assert upsert.update_rows(e, key, {"weight": 3}).where("source = 'a'").first().weight == 3.0
    assert [r.source for r in upsert.delete_rows(e, **key).collect()] == ["b"]
    with pytest.raises(listing.NotFound):
        upsert.delete_rows(e, source="q")
    al = spark.createDataFrame([], "node_id string, alias string, normalized_alias string")
    al = upsert.create_alias(n, al, spark.createDataFrame([("a", " Old  Name ")], "node_id string, alias string"))
    assert al.first().normalized_alias == "old name"
    with pytest.raises(ValueError, match="duplicate"):
        upsert.create_alias(n, al, spark.createDataFrame([("a", "OLD name")], "node_id string, alias string"))
    types = spark.createDataFrame([("uses", None), ("mine", "t2")], "name string, tenant_id string")
    assert upsert.add_relation_type(types, "mine", "t1").count() == 3
    with pytest.raises(ValueError, match="duplicate"):
        upsert.add_relation_type(types, "uses", "t1")
    u = spark.createDataFrame([("likes", False, None), ("eats", False, None)], "relation_type string, resolved boolean, resolved_as string")
    assert {(r.relation_type, r.resolved, r.resolved_as) for r in upsert.resolve_unknown(u, "likes", "prefers").collect()} == {("likes", True, "prefers"), ("eats", False, None)}
    labels = n.withColumn("label", F.upper("id"))
    assert {(r.source_label, r.target_label) for r in graph.edge_nodes(edges_of(spark, ("a", "b"), ("a", "z")), labels).collect()} == {("A", "B"), ("A", None)}
    assert graph.outgoing(n, e).count() == 2


def test_texts_and_mentions(spark, tmp_path):
    from mnemosia.functions import text

    (tmp_path / "a.txt").write_text("one\ntwo")
    assert files.read_texts(spark, str(tmp_path)).first().text == "one\ntwo"
    r = spark.createDataFrame([("We met Big-Bad Wolf.", "big bad", "")], "t string, a string, b string").select(text.mentions(F.col("t"), F.col("a")), text.mentions(F.col("t"), F.col("b"))).first()
    assert tuple(r) == (True, False)


def test_reachable_reads_levels_and_not_all_edges(spark):
    rows = [("a", "b", "r"), ("a", "c", "r"), ("b", "d", "r"), ("c", "d", "s"), ("d", "a", "r"), ("d", "e", "r"), ("x", "y", "r"), ("b", "d", "r"), ("a", "a", "r")]
    edges = spark.createDataFrame(rows, "source string, target string, relation string")
    found = graph.reachable(edges, "a", 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert {tuple(r) for r in found.collect()} == {("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    assert {tuple(r) for r in graph.reachable(edges, "c", 3, ["s"]).collect()} == {("d", 1)}
    assert graph.reachable(edges, "y", 2).collect() == []
