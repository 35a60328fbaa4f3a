"""Phrase and proximity matches against plain Python."""

import random
import re

import pytest

from mnemosia.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    cut = [(i, tuple(w[k : k + 10])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 9))]
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, phrase in cut:
            for k in range(len(w) - len(phrase) + 1):
                if tuple(w[k : k + len(phrase)]) == phrase:
                    hit |= set(range(k, k + len(phrase)))
                    found.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    found = D.decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "items")
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_search(spark, seed):
    rng = random.Random(seed)
    few = [f"t{k}" for k in range(3)]
    many = few + [f"u{k}" for k in range(40)] + ["é", "中文"]
    items = [(k, " ".join(rng.choices(rng.choice([few, many]), k=rng.choice([1, 2, 9, 10, 11, 14])))) for k in range(25)]
    items += [(30, None), (31, ""), (32, "?!"), (2, items[1][1])]
    docs = []
    for k in range(40):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.4 else " ".join(rng.choices(rng.choice([few, many]), k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5))]
        docs.append((k, rng.choice([" ", "-", ".\n"]).join(parts).title()))
    docs += [(100, None), (101, ""), (102, "..."), (0, docs[0][1]), (None, docs[1][1])]
    assert run(spark, docs, items) == plain(docs, items)


def test_repeats_and_overlaps(spark):
    docs = [(1, "a " * 500), (2, "a " * 9), (3, "b a b a b")]
    items = [(1, "a " * 12), (2, "b a b")]
    assert run(spark, docs, items) == plain(docs, items)


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "x")], "doc_id long, text string, pos int, term string")
    items = spark.createDataFrame([(1, "a b", 2)], "item_id long, text string, n int")
    assert [r.n_hit for r in D.decontaminate(docs, items).collect()] == [2]
    assert [r.n_hit for r in D.decontaminate(docs, items.where("false")).collect()] == [0]
    assert D.decontaminate(docs.where("false"), items).collect() == []


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "x a q q b c"), (2, "a " + "z " * 20 + "b"), (3, None)], "doc_id long, text string")
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["q"]), (3, ["a", "nowhere"])], "set_id long, terms array<string>")
    got = sorted(tuple(r) for r in D.near_matches(docs, sets, 5).collect())
    assert got == [(1, 1, 1, 4), (2, 1, 2, 2), (2, 1, 3, 3)]


def test_near_matches_of_three_terms(spark):
    rng = random.Random(4)
    texts = ["x " * 7 + "b x x a x x x b x c", *(" ".join(rng.choices(["a", "b", "b", "c", "c", "d", "x"], weights=[1, 3, 3, 3, 3, 4, 6], k=40)) for _ in range(30))]
    terms, span, want = ["a", "b", "c"], 8, set()
    rows = list(enumerate(texts))
    freq = {t: sum(x.split().count(t) for _, x in rows) for t in terms}
    rare = min(terms, key=lambda t: (freq[t], t))
    for i, x in rows:
        w = x.split()
        for k in [k for k, t in enumerate(w) if t == rare]:
            good = [(e - s, s) for s in range(max(0, k - span + 1), k + 1) for e in range(k, min(len(w), s + span)) if set(terms) <= set(w[s : e + 1])]
            if good:
                n, s = min(good)
                want.add((1, i, s, s + n))
    got = D.near_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, terms)], "set_id long, terms array<string>"), span).collect()
    assert {tuple(r) for r in got} == want and (1, 0, 10, 16) in want


def test_equal_keys_do_not_mix_rows(spark, monkeypatch):
    """Rows are judged by their own words even if their keys are equal."""
    phrase = " ".join(f"b{k}" for k in range(10))
    docs = [(1, f"x {phrase} y"), (2, "clean " * 30), (3, f"{phrase} {phrase} z"), (3, f"{phrase} {phrase} z"), (4, None)]
    items = [(7, phrase), (8, phrase), (None, phrase)]
    monkeypatch.setattr(D.F, "xxhash64", lambda *c: D.F.lit(5).cast("long"))
    assert run(spark, docs, items) == plain(docs, [(7, phrase), (8, phrase)])
    monkeypatch.undo()
    whole = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS n_hit", "3 AS row")
    phrases, _ = D.windows(spark.createDataFrame(items, "item_id long, text string"))
    rows = whole.select(D.F.struct("*").alias("row"), "text")
    assert sorted(r.row.doc_id for r in D.phrase_matches(rows, phrases).where("n_hit = 0").collect()) == [2, 4]


def test_long_texts(spark):
    rng = random.Random(9)
    phrase = [f"b{k}" for k in range(12)]
    text = [f"w{rng.randrange(50)}" for _ in range(30000)]
    docs = [(1, " ".join(text[:29000] + phrase + text[29000:])), (2, " ".join(text)), (3, "")]
    assert run(spark, docs, [(1, " ".join(phrase))]) == plain(docs, [(1, " ".join(phrase))])
