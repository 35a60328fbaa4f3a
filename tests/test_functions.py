import pytest
from pyspark.sql import functions as F

from mnemosia.functions import edtf, text
from mnemosia.operators import ingest, resolve, service


@pytest.mark.parametrize(
    ("query", "intent"),
    [
        ("Who is the mayor?", "entity"), ("What happened on New Year 2019?", "temporal"), ("What is the stance on late trains?", "procedural"),
        ("What is the relationship between Oslo and Bergen?", "relationship"), ("rivers lakes", "general"), ("", "general"),
    ],
)
def test_intent(query, intent):
    assert text.detect_intent(query) == intent


def test_intent_column(spark):
    rows = spark.createDataFrame([("Who is the mayor?",), ("how to cook",), (None,)], "q string")
    assert [r[0] for r in rows.select(text.intent_of(F.col("q"))).collect()] == ["entity", "procedural", "general"]


def test_variants(spark):
    asked = ["What happened at the Harbour Gala in 2019?", " ? ", "Who is the mayor?", "What is the policy on late trains?", "relationship between Oslo and Bergen", "rivers lakes", None]
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select(text.query_variants(F.col("q"))).collect()
    found = [r[0] for r in rows]
    assert found[0] == ["what happened at the harbour gala in 2019", "what happened at the harbour gala", "at the harbour gala in 2019", "harbour", "2019"]
    assert found[1] == [] and found[6] == []
    assert found[2] == ["who is the mayor", "the mayor", "mayor"]
    assert found[3] == ["what is the policy on late trains", "what is the policy on late", "the late trains", "trains"]
    assert "oslo bergen" in found[4] and found[5] == ["rivers lakes", "rivers", "lakes"]
    assert text.temporal_profile("history of platform migration 2024") == (False, True, [2024])
    assert text.temporal_profile("current deployment status") == (True, False, [])


def test_small_functions(spark):
    r = spark.createDataFrame([("ab cD  éx", "2024-01-02T03:04:05.123456789Z", "[1,2.5]", "Big, Bad-Wolf!", "0123456789abcdef")], "a string, t string, v string, m string, k string")
    got = r.select(
        text.title_words(F.col("a")), text.parsed_time(F.col("t")).cast("string"), text.vector_text(text.parsed_vector(F.col("v"))), text.mention_text(F.col("m")),
        text.decrypted(text.encrypted(F.col("a"), F.col("k")), F.col("k")), text.decrypted(F.lit("AAAA"), F.col("k")), text.parsed_time(F.lit("2024-05-06")).cast("string"), text.parsed_time(F.lit("x")),
    ).first()
    assert tuple(got) == ("Ab CD éx", "2024-01-02 03:04:05.123456", "[1.0,2.5]", "big bad wolf", "ab cD  éx", None, "2024-05-06 00:00:00", None)


@pytest.mark.parametrize(
    ("raw", "lower", "upper", "qualifier", "valid"),
    [
        ("2006-01-02", "2006-01-02", "2006-01-02", "exact", True), ("2006-01", "2006-01-01", "2006-01-31", "exact", True), ("2024-02", "2024-02-01", "2024-02-29", "exact", True),
        ("2006", "2006-01-01", "2006-12-31", "exact", True), ("~2006", "2005-01-01", "2007-12-31", "approximate", True), ("2006?", "2005-01-01", "2007-12-31", "estimated", True),
        ("~2006?", "2004-01-01", "2008-12-31", "estimated", True), ("198x", "1980-01-01", "1989-12-31", "decade", True), ("2009/2011", "2009-01-01", "2011-12-31", "range", True),
        ("2009/..", "2009-01-01", None, "range", True), ("../2022", None, "2022-12-31", "range", True), ("~2024-02-29", "2023-03-01", "2025-03-01", "approximate", True),
        ("", None, None, None, True), (None, None, None, None, True), ("abc", None, None, None, False), ("2006-13", None, None, None, False), ("98x", None, None, None, False), ("2009/x", None, None, None, False),
    ],
)
def test_edtf(spark, raw, lower, upper, qualifier, valid):
    r = spark.createDataFrame([(raw,)], "s string").select(edtf.parse(F.col("s")).alias("e")).first().e
    assert (r.lower and str(r.lower), r.upper and str(r.upper), r.qualifier, r.valid) == (lower, upper, qualifier, valid)


def test_search_text(spark):
    rows = spark.createDataFrame([(" Atlas ", "project", '{"zeta":"z","status":"live","owner":"Ann","_x":"no","tags":["a","b"],"n":3}')], "label string, type string, properties string")
    r = rows.select(text.search_text(F.col("label"), F.col("type"), F.col("properties"))).first()[0].split("\n")
    assert r[:7] == ["Atlas", "project", "Ann", "live", "3", "a b", "z"]
    assert "Atlas is owned by Ann" in r and "tags: a, b" in r and not any("no" == x for x in r)


def test_a_text_parses_its_properties_once(spark):
    rows = spark.createDataFrame([("Atlas", "project", '{"owner":"Ann"}'), ("Bare", "project", None), ("Odd", "project", "not json")], "label string, type string, properties string")
    out = rows.select("label", text.search_text(F.col("label"), F.col("type"), F.col("properties")).alias("t"), text.fact_text(F.col("label"), F.col("properties")).alias("f"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(MapType") == 2
    got = {r.label: (r.t, r.f) for r in out.collect()}
    assert got["Atlas"] == ("Atlas\nproject\nAnn\nowner: Ann\nAtlas is owned by Ann", "owner: Ann\nAtlas is owned by Ann")
    assert got["Bare"] == ("Bare\nproject", "") and got["Odd"] == ("Odd\nproject", "")


def test_names(spark):
    rows = spark.createDataFrame([("Acme, Inc.", "acme", 1.0), ("Acme Group Solutions", "Acme", 1.0), ("Beta", "Alphabeta", 0.8), ("x", "y", 0.0)], "a string, b string, s double")
    for r in rows.select(resolve.fuzzy_match(F.col("a"), F.col("b")).alias("g"), "s").collect():
        assert r.g == r.s
    pairs = spark.createDataFrame([("night", "nacht"), ("", "a"), ("aa", "aa")], "a string, b string")
    got = [r[0] for r in pairs.select(resolve.trigram_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(6 / 14) and got[1:] == [0.0, 1.0]


@pytest.mark.parametrize(
    ("raw", "fixed"),
    [('```json\n{"a": 1}\n```', '{"a": 1}'), ('x {"a": [1, 2,],} y', '{"a": [1, 2]}'), ('{"a": [{"b": 1}', '{"a": [{"b": 1}]}'), ("none", "none")],
)
def test_repair_json(raw, fixed):
    assert ingest.repair_json(raw) == fixed


def test_chunks():
    body = "\n".join(["# t"] + ["word " * 20] * 30 + ["## next"] + ["more " * 20] * 5)
    found = ingest._chunks(body, 300)
    assert [c["start_line"] for c in found][0] == 1 and found[-1]["end_line"] == len(body.split("\n"))
    assert all(b["start_line"] == a["end_line"] + 1 for a, b in zip(found, found[1:]))
    assert ingest._chunks("short", 300) == [{"index": 0, "start_line": 1, "end_line": 1, "text": "short"}] and ingest._chunks(None, 3) == []


def test_forms_of_a_query_and_scores_of_a_pair_are_made_from_values_computed_once(spark):
    """What stands several times in an expression is bound; written out it was computed hundreds of times a row."""
    queries = spark.createDataFrame([(1, "Who is Ada Quill?")], "query_id long, text string")
    plan = service.variant_rows(queries)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 3
    names = spark.createDataFrame([("a", "Ada Quill Inc.", "person"), ("b", "", None), ("c", None, "person")], "name_id string, name string, kind string")
    nodes = spark.createDataFrame([("n1", "person", "ada quill"), ("n2", "place", "Ada Quilt co."), ("n3", "person", None)], "id string, type string, label string")
    pairs = names.crossJoin(nodes).select("name_id", "id")
    scored = resolve.scored_candidates(pairs, names, nodes)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("incorporated") <= 10
    assert {tuple(r) for r in scored.collect()} == {("a", "n1", 1.0), ("a", "n2", 0.530909091), ("b", "n1", 0.88), ("b", "n2", 0.88)}
