"""Compaction, oriented edges, merged versions, written batches."""

import random

from pyspark.sql import functions as F

from mnemosia.operators import compaction, ingest, resolve, writing

ENTS = "doc string, seq int, name string, type string, description string, properties map<string,string>"
RELS = "doc string, seq int, source string, target string, relation string, is_current boolean, date_end string"
FACTS = "doc string, seq int, subject string, property string, value string"
NO_ALIASES = "node_id string, alias string, normalized_alias string"


def final(spark, ents, rels, facts, text, known=()):
    e = spark.createDataFrame([("d", i, n, t, None, p) for i, (n, t, p) in enumerate(ents)], ENTS)
    r = spark.createDataFrame([("d", i, *x) for i, x in enumerate(rels)], RELS)
    f = spark.createDataFrame([("d", i, *x) for i, x in enumerate(facts)], FACTS)
    k = spark.createDataFrame([(x,) for x in known], "name string")
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    e, r, f = ingest.finalize(e, r, f, k, docs)
    return {x.name for x in e.collect()}, {(x.source, x.relation, x.target) for x in r.collect()}, {(x.subject, x.property) for x in f.collect()}


def test_a_profile_keeps_what_its_text_supports(spark):
    text = "# SOUL.md - Who I Am\n\nI am Rover.\n\nNora is the engineer.\nTidepool is the project."
    ents = [("Rover", "service", None), ("Nora Vance", "person", None), ("Tidepool", "project", None), ("Type 9 Fever", "concept", None), ("Springfield, Ohio", "place", None)]
    rels = [("Nora Vance", "Tidepool", "works_on", None, None), ("Nora Vance", "Rover", "owns", None, None), ("Rover", "Tidepool", "works_on", None, None), ("Some Helper", "Tidepool", "works_on", None, None)]
    e, r, f = final(spark, ents, rels, [("Nora Vance", "faith", "x")], text, ["Nora Vance"])
    assert e == {"Rover", "Nora Vance", "Tidepool"} and ("Rover", "works_on", "Tidepool") in r and not any("Some Helper" in x for x in r) and f == {("Nora Vance", "faith")}


def test_edges_follow_both_ends(spark):
    text = "# USER.md\n- Nora Vance\n- Paul Vance\n- Harbor, Inc.\n- Tidepool\n- Quill"
    ents = [("Nora Vance", "person", {"birthday": "1982-08-14"}), ("Paul Vance", "person", {"birthday": "1961-01-01"}), ("Harbor, Inc.", "company", None), ("Tidepool", "project", None), ("Quill", "project", None)]
    rels = [
        ("Nora Vance", "Paul Vance", "parent_of", None, None), ("Nora Vance", "Harbor, Inc.", "works_at", False, None), ("Nora Vance", "Tidepool", "product_of", None, None), ("Laura", "Nora Vance", "married_to", None, None),
        ("Paul Vance", "Harbor, Inc.", "works_at", None, "2001"), ("Quill", "Paul Vance", "created", None, None), ("Paul Vance", "Tidepool", "founded", None, None), ("Paul Vance", "Nora Vance", "looks_like", None, None),
    ]
    _, r, _ = final(spark, ents, rels, [], text)
    assert r == {
        ("Nora Vance", "child_of", "Paul Vance"), ("Nora Vance", "worked_at", "Harbor, Inc."), ("Nora Vance", "created", "Tidepool"), ("Paul Vance", "worked_at", "Harbor, Inc."), ("Paul Vance", "created", "Quill"),
        ("Paul Vance", "created", "Tidepool"),
    }


def test_facts_outdo_properties_for_birthdays(spark):
    ents = spark.createDataFrame([("d", 1, "A", "person", None, {"birthday": "1950"}), ("d", 2, "B", "person", None, {"birth_date": "1970"})], ENTS)
    rels = spark.createDataFrame([("d", 1, "A", "B", "child_of", None, None)], RELS)
    plain = lambda facts: compaction.oriented(rels, ents, spark.createDataFrame(facts, FACTS)).first().relation
    assert plain([]) == "parent_of" and plain([("d", 1, "a ", "birthday", "1990")]) == "child_of" and plain([("d", 1, "A", "birthday", "")]) == "child_of"


def test_document_kinds(spark):
    texts = ["# User.md x", "x" * 1990 + "# user.md", "- **a** " * 6, "- **a** " * 5, None, "é" * 995 + "# user.md", "é" * 1000 + "# user.md"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.k for r in rows.orderBy("i").select(compaction.document_kind(F.col("t")).alias("k")).collect()] == ["profile", "profile", "profile", "general", "general", "profile", "general"]


def test_a_profile_has_twelve_entities_at_most(spark):
    names = [f"Person{k:02d} Last" for k in range(20)]
    e, _, _ = final(spark, [(n, "person", None) for n in names], [], [(n, f"p{j}", "v") for k, n in enumerate(names) for j in range(k % 7 + 1)], "# user.md " + " ".join(names))
    scores = sorted(((-(k % 7 + 1), n) for k, n in enumerate(names)))
    assert e == {n for _, n in scores[:12]}


def test_versions_are_folded_in_order(spark):
    rng = random.Random(2)
    rows = [(f"n{rng.randrange(4)}", rng.choice(["a", "b", "_ingested_at"]), i, rng.choice(["x", "y", None]), f"s{i}", f"t{i}") for i in range(200)]
    rng.shuffle(rows)
    current, history = writing.merged_versions(spark.createDataFrame(rows, "node_id string, property string, seq long, value string, source string, changed_at string"))
    now, past = {}, set()
    for n, p, seq, v, s, _ in sorted(rows, key=lambda r: r[2]):
        if p == "_ingested_at":
            continue
        if (n, p) in now and now[n, p] != v:
            past.add((n, p, seq, now[n, p], v, s))
        now[n, p] = v
    assert {(r.node_id, r.property): r.value for r in current.collect()} == now
    assert {(r.node_id, r.property, r.seq, r.old_value, r.new_value, r.source) for r in history.collect()} == past
    nodes = spark.createDataFrame([("n0",), ("other",)], "id string")
    got = {r.id: r.property_history for r in writing.with_history(nodes, history).collect()}
    assert got["other"] is None and [x.seq for x in got["n0"]] == sorted(h[2] for h in past if h[0] == "n0")


def test_a_batch_makes_one_node_of_each_group_and_a_rerun_changes_nothing(spark):
    nodes = spark.createDataFrame([("p1", "person", "Nora Vance", {"role": "dev"}), ("c1", "company", "Harbor", None)], "id string, type string, label string, properties map<string,string>")
    none = spark.createDataFrame([], NO_ALIASES)
    ents = spark.createDataFrame(
        [(1, "nora vance", "person", {"role": "lead", "city": "Rome"}), (2, "Harbor, Inc.", "company", {}), (3, "Quill Works LLC", "company", {"a": "1"}), (4, "quill works", "company", {"a": "2", "b": "x"}), (5, "QUILL WORKS", "company", {"a": "2"}), (6, " ", "person", {}), (7, "Zed", "person", {})],
        "seq int, name string, type string, properties map<string,string>",
    )
    got = writing.write_entities(nodes, none, ents, "file", "2024-01-01")
    made = {r.seq: (r.action, r.node_id) for r in got["actions"].collect()}
    assert made[1] == ("updated", "p1") and made[2] == ("updated", "c1") and made[3][0] == made[7][0] == "created" and made[4] == made[5] == ("updated", made[3][1]) and 6 not in made
    after = {r.id: (r.label, r.properties) for r in got["nodes"].collect()}
    assert after["p1"] == ("Nora Vance", {"role": "lead", "city": "Rome"}) and after["c1"] == ("Harbor", None) and len(after) == 4
    assert after[made[3][1]] == ("Quill Works LLC", {"_ingested_from": "file", "_ingested_at": "2024-01-01", "a": "2", "b": "x"})
    assert {(r.node_id, r.property, r.old_value, r.new_value, r.source) for r in got["history"].collect()} == {("p1", "role", "dev", "lead", "file"), (made[3][1], "a", "1", "2", "file")}
    rows = got["nodes"].collect()
    again = writing.write_entities(spark.createDataFrame(rows, nodes.schema), none, ents.where("seq <> 3"), "file", "2025")
    assert {r.action for r in again["actions"].collect()} == {"updated"} and again["history"].count() == 0
    assert sorted(map(str, again["nodes"].collect())) == sorted(map(str, rows))


def test_names_are_found_by_search(spark):
    labels = ["John Smith", "Jane Smith", "Acme", "Jonathan Quince"] + [f"Filler {k}" for k in range(30)]
    nodes = spark.createDataFrame([(f"n{i}", "person", x) for i, x in enumerate(labels)], "id string, type string, label string")
    names = spark.createDataFrame([(1, "Jonh Smith", "person"), (2, "Smith, John", "person"), (3, "", "person"), (4, None, "person"), (5, "nobody here", "person")], "name_id int, name string, kind string")
    aliases = spark.createDataFrame([], NO_ALIASES)
    found = {}
    for r in resolve.search_candidates(names.where("name IS NOT NULL"), nodes, aliases).collect():
        found.setdefault(r.name_id, set()).add(r.id)
    assert found == {1: {"n0", "n1"}, 2: {"n0"}}
    got = {r.name_id: (r.status, r.node_id) for r in resolve.resolve(names, nodes, aliases, lookup=True).collect()}
    assert got[1][0] == "ambiguous" and got[3] == got[4] == got[5] == ("no_match", None)


def test_tables_without_rows(spark):
    ents, rels, facts = (spark.createDataFrame([], s) for s in (ENTS, RELS, FACTS))
    docs = spark.createDataFrame([], "doc string, text string")
    assert [t.count() for t in compaction.compact(docs, ents, rels, facts)] == [0, 0, 0]
    nodes = spark.createDataFrame([], "id string, type string, label string, properties map<string,string>")
    got = writing.write_entities(nodes, spark.createDataFrame([], NO_ALIASES), spark.createDataFrame([], "seq int, name string, type string, properties map<string,string>"), "s", "t")
    assert [got[k].count() for k in ("nodes", "actions", "history")] == [0, 0, 0]


def test_the_names_of_a_batch_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(name):
        seen.add(1)
        return name

    counted = F.udf(count, "string").asNondeterministic()
    nodes = spark.createDataFrame([("n1", "person", "Ann Lee", {"a": "1"})], "id string, type string, label string, properties map<string,string>")
    none = spark.createDataFrame([], "node_id string, alias string, normalized_alias string")
    entities = spark.createDataFrame([(1, "ANN LEE", "person", {"a": "2"}), (2, "Bob Ray", "person", {"a": "3"})], "seq long, name string, type string, properties map<string,string>")
    got = writing.write_entities(nodes, none, entities.select("seq", counted("name").alias("name"), "type", "properties"), "s", "t")
    assert {(r.seq, r.action) for r in got["actions"].collect()} == {(1, "updated"), (2, "created")}
    # two rows, read seven times; eleven times while every reading of the names made them anew
    assert seen.value <= 2 * 7
