"""Near-duplicates against plain Python over all pairs."""

import random
import re

import pytest

from mnemosia.llm import minhash as M

SCHEMA = "doc_id long, text string"


def shingles(text, n=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def corpus(seed, n):
    """Families of changed copies whose similarities lie on both sides of 0.8, and chains of them."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    while len(texts) < n:
        base = rng.choices(words, k=rng.choice([3, 5, 20, 60, 120]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\t".join(copy))
            if rng.random() < 0.5:
                base = copy
    return list(enumerate(texts[:n], 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed, 150) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "two one")]
    got = M.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_large_group_of_copies_and_common_passage(spark):
    rng = random.Random(3)
    words = [f"v{k}" for k in range(2000)]
    passage, base = " ".join(rng.choices(words, k=30)), rng.choices(words, k=100)
    rows = [(i, " ".join(base)) for i in range(10, 60)]
    rows += [(i, " ".join(base[: i % 90] + [f"x{i}"] + base[i % 90 + 1 :])) for i in range(60, 110)]
    rows += [(i, passage + " " + " ".join(rng.choices(words, k=40))) for i in range(110, 150)]
    got = M.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_a_long_chain_is_one_component(spark):
    words = [f"c{k}" for k in range(200)]
    rows = [(100 - i, " ".join(words[i * 3 : i * 3 + 80])) for i in range(40)]
    assert plain(rows)[0][2] == 61
    got = M.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_defined_cases(spark):
    docs = spark.createDataFrame([], SCHEMA + ", n_shingles int, node long, component_id long")
    assert M.near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(7, "a b c d e", 1, 1, 1), (7, "a b c d e", 1, 1, 1), (None, "a b c d e", 1, 1, 1), (None, None, 1, 1, 1)], docs.schema)
    got = sorted(map(str, (tuple(r) for r in M.near_duplicates(docs).collect())))
    assert got == sorted(["(7, 2, 7, True)", "(7, 2, 7, True)", "(None, 2, 7, False)", "(None, 0, None, False)"])
    kept = M.near_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns


def test_one_row_of_equal_doc_ids_stays(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (7, "z y x w v"), (8, "a b c d e"), (9, "k l m n o"), (10, None), (10, ""), (None, "a b c d e"), (None, "a b c d e")]
    kept = M.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "a b c d e"), (0, "a b c d e"), (7, "a b c d e"), (9, "k l m n o"), (10, "")]


def test_texts_of_one_doc_id_link_their_classes(spark):
    rng = random.Random(5)
    words = [f"v{k}" for k in range(2000)]
    a, b = rng.choices(words, k=60), rng.choices(words, k=60)
    near = lambda t: " ".join(t[:30] + ["changed"] + t[31:])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(rng.choices(words, k=60)))]
    got = {(r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}


def test_templates_a_little_below_the_threshold_do_not_meet(spark):
    """Texts that share three quarters of their shingles: no pair is looked at, however many they are."""
    template = " ".join(f"t{k}" for k in range(90))
    rows = [(i, template + " " + " ".join(f"x{i}_{k}" for k in range(12))) for i in range(400)]
    texts = spark.createDataFrame(rows, "node long, text string")
    postings = texts.selectExpr("node", "99L AS n", "1L AS key", "node AS comp")
    assert M._rest(postings, texts, M.SHINGLE).count() == 0
    got = M.near_duplicates(texts.withColumnRenamed("node", "doc_id")).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 400


def test_components_read_an_edge_only_until_it_lies_within_one(spark, monkeypatch):
    rng = random.Random(3)
    chain = rng.sample(range(2000), 2000)
    edges = list(zip(chain, chain[1:])) + [(5000, 5001), (5001, 5002), (7000, 7000)]
    rows, store = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df, name="t": (out := store(df, name), rows.append(out.count()))[0])
    got = {r.node: r.comp for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in chain} | {k: 5000 for k in (5000, 5001, 5002)}
    assert sum(rows) <= 6 * len(edges)


def test_further_links_join_components_and_new_nodes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = M.components(frame([(1, 2), (3, 4), (8, 9)]))
    got = M.extended(labels, frame([(4, 2), (5, 4), (11, 10), (9, 8)]))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8), (10, 10), (11, 10)]
