"""Postings, shaping, duplicates of common names, the feed's state, the sink, running medians."""

import itertools
import math
import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemosia.functions.text import stem, stemmed_word
from mnemosia.operators import aggregates, duplicates, postings, session, shaping
from mnemosia.sources import sink
from mnemosia.streaming import feed


def rank(places):
    """Rank of a text by its lists of places, one for each lexeme of the query."""
    if len(places) == 1:
        return 0.1 * sum(1 / n**2 for n in range(1, len(places[0]) + 1)) / 1.64493406685
    rest = 1.0
    for a, b in itertools.combinations(places, 2):
        for x, y in itertools.product(a, b):
            d = abs(x - y)
            rest *= 1 - (1e-16 if d > 100 else 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
    return 1 - rest


def test_hits_against_all_texts(spark):
    rng = random.Random(1)
    words = ["aa", "bb", "cc", "dd", "ee", "ff"]
    texts = {f"n{i}": " ".join(rng.choice(words[: 2 + i % 5]) for _ in range(rng.choice([0, 3, 20, 150]))) for i in range(60)}
    nodes = spark.createDataFrame([(i, t) for i, t in texts.items()], "id string, search_text string")
    queries = {0: "aa", 1: "bb aa", 2: "dd, CC aa", 3: "ee ff aa bb", 4: "zz aa", 5: "", 6: "x"}
    built = postings.build(nodes, stemmed=False, buckets=4)
    got = {(r.query_id, r.id): r.match for r in postings.hits(built, spark.createDataFrame(list(queries.items()), "query_id int, text string")).collect()}
    want = {}
    for q, text in queries.items():
        asked = list(dict.fromkeys(w for w in text.lower().replace(",", "").split() if len(w) > 1))
        for i, t in texts.items():
            at = [[k + 1 for k, w in enumerate(t.split()) if w == a] for a in asked]
            if at and all(at):
                want[q, i] = rank(at)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_stems_and_aliases(spark):
    nodes = spark.createDataFrame([("g", "person", "William Gates", 1.0, 1), ("p", "project", "Harbor notes: deploying services", 1.0, 1)], "id string, type string, search_text string, salience_score double, updated_at int")
    aliases = spark.createDataFrame([("g", "Bill Gates", "bill gates"), ("g", "  William H. Gates  ", "william h. gates")], "node_id string, alias string, normalized_alias string")
    built = postings.build(nodes, aliases)
    asked = spark.createDataFrame([(1, "Bill Gates"), (2, "william h. gates"), (3, "deployed service"), (4, "gates bill"), (5, "harbor gates")], "query_id int, text string")
    got = {(r.query_id, r.id): r.match for r in postings.search(built, nodes, aliases, asked).collect()}
    near = rank([[1], [2]])
    assert got.keys() == {(1, "g"), (2, "g"), (3, "p"), (4, "g")} and got[1, "g"] == 1.0 and got[2, "g"] == 0.95 and got[4, "g"] == pytest.approx(0.9 * near) and got[3, "p"] == pytest.approx(near)
    assert postings.search(built, nodes, aliases, asked, kind="project").count() == 1


def test_each_query_is_shaped_by_its_own_words(spark):
    t = "timestamp_ntz'{}-06-01 00:00:00'"
    nodes = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('n{k}', 'node {k}', 'seen in {1990 + k}', false, 1.0D, {t.format(2000 + k)}, {t.format(2000 + k)})" for k in range(6)) + " AS v(id, label, search_text, user_boosted, salience_score, updated_at, created_at)")
    queries = spark.createDataFrame([(1, "latest node"), (2, "history of node"), (3, "node in 1993"), (4, "node")], "query_id int, text string")
    candidates = queries.select("query_id").crossJoin(nodes.select("id")).withColumn("rank", F.lit(1))
    first = {r.query_id: r.id for r in shaping.shaped(candidates, queries, nodes).where("rank = 1").collect()}
    assert first[1] == "n5" and first[2] == "n0" and first[3] == "n3"
    again = {r.query_id: r.id for r in shaping.reranked(candidates, spark.createDataFrame([(1, "node 4"), (2, "node 2"), (3, "...")], "query_id int, text string"), nodes, limit=2).where("rank = 1").collect()}
    assert again[1] == "n4" and again[2] == "n2" and again[3] in {f"n{k}" for k in range(6)}
    assert shaping.rerank_limit(10) == 30 and shaping.rerank_limit(20) == 50


def all_pairs(nodes, aliases, limit):
    names = {}
    for i, kind, label, salience, _ in nodes:
        own = {label.lower(): True}
        for a, n in aliases:
            if a == i:
                own.setdefault(n, False)
        names[i] = (kind, salience, own)
    out = []
    for x, y in itertools.combinations(sorted(names), 2):
        a, b = names[x], names[y]
        both = sorted(set(a[2]) & set(b[2])) if a[0] == b[0] else []
        if both:
            out.append((x, y, both, any(a[2][n] and b[2][n] for n in both), any(a[2][n] != b[2][n] for n in both), max(a[1], b[1])))
    return [r[:5] for r in sorted(out, key=lambda r: (-r[3], -len(r[2]), -r[5], r[0], r[1]))[:limit]]


NODES, ALIASES = "id string, type string, label string, salience_score double, superseded_by string", "node_id string, normalized_alias string"


@pytest.mark.parametrize("few", [1, 4, 64])
def test_first_duplicates_are_those_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(duplicates, "FEW_NODES", few)
    rng = random.Random(few)
    nodes = [(f"n{k:03d}", "tu"[rng.random() < 0.2], rng.choice(["ann", "bob", "cy", "dee", f"x{k}"]), float(rng.choice([1, 2, 3, k])), None) for k in range(80)]
    aliases = [(f"n{rng.randrange(80):03d}", rng.choice(["ann", "bob", "q", "r", f"z{k % 20}"])) for k in range(80)]
    got = duplicates.duplicate_pairs(spark.createDataFrame(nodes, NODES), spark.createDataFrame(aliases, ALIASES), limit=30)
    assert [tuple(r) for r in got.collect()] == all_pairs(nodes, aliases, 30)


def test_a_name_of_all_nodes_makes_no_pairs_of_all(spark):
    nodes = spark.createDataFrame([(f"n{k:05d}", "t", "same", 1.0, None) for k in range(3000)], NODES)
    got = duplicates.duplicate_pairs(nodes, spark.createDataFrame([(f"n{k:05d}", f"own{k}") for k in range(3000)], ALIASES))
    assert [(r.left_id, r.right_id) for r in got.collect()] == [("n00000", f"n{k:05d}") for k in range(1, 26)]


def changes(spark, rows):
    return spark.createDataFrame(rows, "change_id long, tenant string, type string, ts string, payload string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


class StateOf:
    """Stands for both kinds of state of one tenant, and counts the calls."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def getValueState(self, *_, **__):
        return self

    getMapState = getValueState

    def __getattribute__(self, name):
        own = object.__getattribute__(self, "__dict__")
        if name in ("exists", "get", "update", "containsKey", "getValue", "updateValue", "removeKey", "clear"):
            own["calls"] += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key, None)

    def clear(self):
        self.map.clear()


def test_a_batch_calls_the_state_by_blocks_and_not_by_rows():
    state, numbering, at = StateOf(), feed.Numbering(100, 10**6), 0
    numbering.init(state)
    for n in (150, 30, 150, 1, 1):
        rows = [Row(change_id=at + k, type="x", ts=datetime(2024, 1, 1) + timedelta(seconds=at + k), payload="{}") for k in range(n)]
        assert [r.seq for r in numbering.handleInputRows(("t",), iter(rows), None)] == list(range(at + 1, at + n + 1))
        at += n
        oldest = state.value[1]
        held = sorted(first[0] + k for first, block in state.map.items() for k in range(len(block[0])))
        assert [seq for seq in held if seq >= oldest] == list(range(at - 99, at + 1)) and len(held) < 100 + feed.BLOCK
    assert state.calls <= 8 * 5


def test_the_stream_gives_the_batch_numbers_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("ttttuv"), "x", f"2024-01-{1 + i // 40:02d} {i // 4 % 24:02d}:{i % 60:02d}:00", "{}") for i in range(400)]
    rows.sort(key=lambda r: (r[3], r[0]))
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    for part in (rows[:100], rows[100:101], rows[101:]):
        feed.publish(changes(spark, part), f"{tmp_path}/log")
        feed.run_numbering(spark, f"{tmp_path}/log", f"{tmp_path}/state", f"{tmp_path}/out", 30, 2 * 86400)
    feed.run_numbering(spark, f"{tmp_path}/log", f"{tmp_path}/state", f"{tmp_path}/out", 30, 2 * 86400)
    every = changes(spark, rows)
    key = ["tenant", "seq", "change_id"]
    stream = spark.read.schema(feed.NUMBERED).parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, stream.select(key).collect())) == sorted(map(tuple, feed.sequenced(every).select(key).collect()))
    held = feed.held(spark, f"{tmp_path}/state")
    want = []
    for t in "tuv":
        own = [r for r in rows if r[1] == t]
        newest = max(r[3] for r in own)
        cutoff = f"2024-01-{int(newest[8:10]) - 2:02d}{newest[10:]}"
        want += [(t, k + 1, r[0]) for k, r in enumerate(own) if k + 1 > len(own) - 30 and r[3] >= cutoff]
    assert sorted(map(tuple, held.select(key).collect())) == sorted(want)
    oldest = min(s for t, s, _ in want if t == "t")
    assert feed.replay(held, "t", oldest - 1)[1] and not feed.replay(held, "t", oldest)[1] and not feed.replay(held, "t", 0)[1]


def test_a_buffer_counts_what_it_does_not_hold(spark):
    rows = [(i, "t", "x", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "{}") for i in range(180)] + [(1000, "t", "x", None, "{}")]
    got = {r.change_id: r.seq for r in feed.buffered(changes(spark, rows), "2024-01-01 02:59:00", 50, 3600).collect()}
    assert got == {i: i + 2 for i in range(131, 180)} | {130: 132}


def test_the_sink_keeps_a_ledger(spark, tmp_path):
    def function(texts):
        if any("bad" in t for t in texts):
            raise TimeoutError("no answer")
        return [[float(len(t))] for t in texts]

    ledger = sink.Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.rows().count() == 0
    rows = spark.createDataFrame([("a", "fine"), ("b", "bad one"), ("c", None)], "id string, text string").coalesce(1)
    ledger.write(rows, 0, function, delay_s=0.0)
    assert {r.id: (r.result, r.error, r.tries) for r in ledger.latest().collect()} == {"a": ([4.0], None, 4), "b": (None, "TimeoutError: no answer", 6), "c": ([0.0], None, 4)}
    ledger.write(rows.where("false"), 1, function, delay_s=0.0)
    ledger.write(rows.where("false"), 1, function, delay_s=0.0)  # a batch that runs again replaces itself
    assert [(r.id, r.runs) for r in ledger.dead_letters().collect()] == [("b", 2)] and ledger.dead_letters(most_runs=2).count() == 0
    ledger.write(rows.where("false"), 2, function, most_runs=2, delay_s=0.0)
    assert ledger.dead_letters().first().runs == 2
    ledger.write(spark.createDataFrame([("b", "now good")], "id string, text string"), 3, function)
    assert ledger.dead_letters().count() == 0 and {r.id for r in ledger.results().collect()} == {"a", "b", "c"}


def test_the_sink_stops_calling_what_is_down(spark):
    calls = spark.sparkContext.accumulator(0)

    def down(texts):
        calls.add(1)
        raise OSError("down")

    rows = spark.createDataFrame([(str(i), "x") for i in range(40)], "id string, text string").coalesce(1)
    got = sink.called(rows, down, attempts=1, breaker=3).collect()
    assert len(got) == 40 and calls.value == 4 and sum(r.error.startswith("not called") for r in got) == 37


def test_the_sink_takes_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", "fine")], "id string, text string").write.parquet(f"{tmp_path}/in")
    ledger = sink.Ledger(spark, f"{tmp_path}/ledger")
    ledger.start(spark.readStream.schema("id string, text string").parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", lambda texts: [[1.0] for _ in texts], once=True).awaitTermination()
    assert ledger.results().count() == 1


def test_running_medians(spark):
    rng = random.Random(4)
    rows = [(run, seq, rng.choice([None, 0.0, -1.0, *[rng.random()] * 4]), 300.0) for run in ("a", "b", None) for seq in range(200)]
    got = {(r.run, r.seq): (r.median, r.drop) for r in aggregates.throughput_drops(spark.createDataFrame(rows, "run string, seq int, rate double, ms double").repartition(3)).collect()}
    for run in ("a", "b", None):
        before = []
        for _, seq, rate, _ in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            m = median(before) if before else None
            assert got[run, seq] == (pytest.approx(m) if before else None, bool(len(before) >= 3 and rate is not None and rate <= 0.3 * m))
            before += [rate] if rate is not None and rate > 0 else []


def test_contexts_of_a_session(spark):
    rows = [
        (1, "fix the parser", None, [" last  words ", "LAST words", "older"], ["  branch x "]), (2, "who is Nora", ["Nora", "nora", "", None, "a", "b", "c", "d", "e", "f"], None, None),
        (3, "plain words", [], [], []), (4, "plain words", [], ["Plain  words plain words"], ["x" * 300]), (5, "", None, None, None),
    ]
    got = {r.query_id: r for r in session.retrieval_context(spark.createDataFrame(rows, "query_id int, text string, entities array<string>, messages array<string>, work array<string>")).collect()}
    assert got[1].source == "file" and got[1].forms == ["fix the parser", "fix the parser branch x", "fix the parser last words"] and got[1].messages == ["last words", "older"]
    assert got[2].source == "graph" and got[2].entities == ["Nora", "a", "b", "c", "d", "e"] and got[2].forms == ["who is Nora", "who is Nora Nora a b"]
    assert got[3].source == "both" and got[3].forms == ["plain words"] and len(got[4].work[0]) == 240 and got[5].forms == []
    hits = spark.createDataFrame([(1, "x", "file", 3.0), (1, "y", "graph", 2.0), (1, "z", "file", 0.5)], "query_id int, key string, source string, score double")
    assert [(r.key, r.rank, r.why) for r in session.unified(hits, 1.0, 5).orderBy("rank").collect()] == [("x", 1, "file-memory match"), ("y", 2, "knowledge-graph match")]


def rows_of(plan, name="Join"):
    """The most rows that a node of the executed plan with this word in its name made."""
    kind, out = plan.nodeName(), 0
    if kind == "AdaptiveSparkPlan":
        return rows_of(plan.executedPlan(), name)
    if "QueryStage" in kind:
        return rows_of(plan.plan(), name)
    if name in kind and plan.metrics().contains("numOutputRows"):
        out = plan.metrics().apply("numOutputRows").value()
    children = plan.children()
    return max([out, *(rows_of(children.apply(i), name) for i in range(children.size()))])


def test_queries_of_a_nation_do_not_meet_all_its_customers(spark, tmp_path):
    from mnemosia.plans import searching

    spark.range(1, 3001).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "3L AS c_nationkey", "'A' AS c_mktsegment", "CAST(id % 100 * 100 AS double) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    _, candidates, _, _ = searching._shaping_inputs(spark, str(tmp_path))
    assert candidates.groupBy().count().first()[0] == 100 * 30
    candidates.collect()
    assert rows_of(candidates._jdf.queryExecution().executedPlan()) <= 100 * 30


def test_stored_postings_are_not_shuffled_by_a_search(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"alpha beta word{i % 7}") for i in range(40)], "id string, search_text string")
    built = postings.build(nodes, buckets=3)
    found = postings.hits(built, spark.createDataFrame([(1, "alpha beta"), (2, "word3 beta"), (3, "alpha")], "query_id int, text string"))
    assert found.count() == 40 + 6 + 40
    # of the stored rows only those of asked lexemes leave their buckets: no exchange right above the scan
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    scans = [k for k, line in enumerate(lines) if "FileScan parquet" in line and "postings_" in line]
    above = [next(x for x in reversed(lines[:k]) if any(w in x for w in ("Join", "Exchange"))) for k in scans]
    assert scans and all("ShuffledHashJoin" in x for x in above)


def test_places_of_long_texts_and_of_texts_of_one_id(spark):
    texts = [("a", "Running runs, the runner ran; été 東京 x"), ("b", " ".join(["loop"] * 300 + ["end"])), ("c", None), ("d", "..."), ("e", "one two"), ("e", "two one two")]
    nodes = spark.createDataFrame(texts, "id string, search_text string")
    for own in (nodes, nodes.where("id <> 'e'")):
        built = postings.build(own, buckets=2)
        got = {(r.lexeme, t.id): list(postings._unpacked(bytes(t.places))) for r in built.rows.collect() for t in r.texts}
        assert got["run", "a"] == [2] and got["runn", "a"] == [1] and got["été", "a"] == [6] and got["loop", "b"] == list(range(1, 256)) and got["end", "b"] == [301]
        assert {i for _, i in got} == ({"a", "b", "e"} if own is nodes else {"a", "b"})
        assert own is not nodes or got["two", "e"] == [1, 2, 3] and got["one", "e"] == [1, 2]
        assert {r.lexeme: r.texts for r in built.counts.collect()}["loop"] == 1


def test_a_word_is_stemmed_as_in_a_column(spark):
    words = ["running", "ties", "tied", "abced", "stations", "e", "ly", "quickly", "bye", "été", "𝒳𝒳𝒳es", "2000s", "ingly", "meetingly", "aaai", "yyyy", "İngs"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == {w: stemmed_word(w) for w in words}
