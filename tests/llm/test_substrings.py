"""Fuzzy passages: chaining against an exhaustive search, planted passages against the result."""

import random
import re
import zlib

import numpy as np
import pytest

from mnemosia.llm import substrings as S

S_WORDS = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def numbers(w):
    return np.array([zlib.crc32(x.encode()) for x in w], np.uint32)


def words(rng, n, prefix):
    return [f"{prefix}{rng.randrange(10**6)}" for _ in range(n)]


def best_score(pos, hub):
    """Of all collinear chains, by trying every predecessor."""
    order = sorted(range(len(pos)), key=lambda i: (pos[i], -hub[i]))
    score = {}
    for i in order:
        gains = [score[j] - S.GAP_COST * (pos[i] - pos[j] + hub[i] - hub[j]) for j in score if pos[j] <= pos[i] and hub[j] < hub[i]]
        score[i] = S.K + max([0.0, *gains])
    return max(score.values())


def test_the_tree_finds_the_best_chain():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 15)
        places = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(n)})
        pos, hub = [p for p, _ in places], [q for _, q in places]
        found = S.chains(pos, hub)
        assert sorted(i for c in found for i in c) == list(range(len(pos)))
        c = found[0]
        got = S.K * len(c) - S.GAP_COST * (pos[c[-1]] - pos[c[0]] + hub[c[-1]] - hub[c[0]])
        assert abs(got - best_score(pos, hub)) < 1e-9


def test_common_words_of_two_stretches():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert S.common(np.array(a, np.uint32), np.array(b, np.uint32)) == table[-1][-1]


def test_planted_passages(spark):
    rng = random.Random(3)
    passage = words(rng, 80, "p")
    fuzzy = list(passage)
    for k in (13, 37, 61):
        fuzzy[k] = "changed"
    del fuzzy[50]
    copy = words(rng, 120, "c")
    rows = {
        1: words(rng, 100, "a") + passage + words(rng, 50, "b"),
        2: words(rng, 30, "d") + passage + words(rng, 150, "e"),
        3: words(rng, 70, "f") + fuzzy + words(rng, 20, "g"),
        4: words(rng, 300, "h"),
        5: copy,
        6: copy,
        7: words(rng, 60, "i") + passage[:30] + words(rng, 60, "j"),
    }
    docs = spark.createDataFrame([(i, " ".join(w).title()) for i, w in rows.items()] + [(8, None), (9, "")], "doc_id long, text string")
    got = S.repeated_passages(docs).collect()
    assert {(r.doc_id, r.kind) for r in got} == {(2, "passage"), (3, "passage"), (6, "copy")}
    exact = next(r for r in got if r.doc_id == 2)
    assert (exact.start, exact.end, exact.source_doc, exact.source_start, exact.n_equal) == (30, 110, 1, 100, 80)
    near = next(r for r in got if r.doc_id == 3)
    assert near.start == 70 and near.end >= 70 + 75 and near.source_doc == 1


def test_a_passage_that_many_texts_share(spark):
    rng = random.Random(4)
    passage = words(rng, 60, "p")
    docs = spark.createDataFrame([(i, " ".join(words(rng, 20 + i % 7, "a") + passage + words(rng, 30, "b"))) for i in range(200)], "doc_id long, text string")
    got = S.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == set(range(1, 200))
    assert len(got) < 300  # linear in the texts, not in their pairs
    assert all(r.source_doc < r.doc_id for r in got)


def test_two_passages_in_the_same_two_texts(spark):
    for between in (40, 90, 300):
        rng = random.Random(between)
        one, two = words(rng, 60, "p"), words(rng, 60, "q")
        rows = [(k, " ".join(one + words(rng, between, "x") + two + words(rng, 30, "y"))) for k in (1, 2)]
        got = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.start, r.end, r.source_start, r.n_equal) for r in got) == [(2, 0, 60, 0, 60), (2, 60 + between, 120 + between, 60 + between, 60)]


def test_stretches_with_enough_equal_words():
    rng = random.Random(6)
    for _ in range(300):
        p, q, runs = 0, 0, []
        for _ in range(rng.randrange(1, 9)):
            n = rng.randrange(1, 20)
            runs.append((p, q, n, 1))
            p, q = p + n + rng.randrange(8), q + n + rng.randrange(8)
        good = [(i, j) for i in range(len(runs)) for j in range(i, len(runs)) if 5 * sum(r[2] for r in runs[i : j + 1]) >= 4 * max(runs[j][k] + runs[j][2] - runs[i][k] for k in (0, 1))]
        longest = [x for x in good if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in good)]
        assert S.passing(np.array(runs), 0.8) == longest


def test_changed_words_anywhere(spark):
    """Recall on passages of 60 and 100 words with 15 and 18 of 100 words changed, where a search along the passage finds 50 words with 0.8 equal."""
    rng = random.Random(7)
    rows, want, seeded = [], set(), set()
    for k in range(400):
        n, rate = rng.choice([60, 100]), rng.choice([0.15, 0.18])
        one = words(rng, n, "p")
        two = [f"z{rng.randrange(10**6)}" if rng.random() < rate else w for w in one]
        rows += [(2 * k, " ".join(words(rng, 30, "a") + one + words(rng, 30, "b"))), (2 * k + 1, " ".join(words(rng, 9, "c") + two + words(rng, 80, "d")))]
        same = [x == y for x, y in zip(one, two)]
        grams = [all(same[i : i + 8]) for i in range(n - 7)]
        if any(same[i] and same[j - 1] and 5 * sum(same[i:j]) >= 4 * (j - i) for i in range(n) for j in range(i + 50, n + 1)):
            want.add(2 * k + 1)
            if any(5 * sum(same[i:j]) >= 4 * (j - i) and any(grams[i : j - 7]) and same[i] and same[j - 1] for i in range(n) for j in range(i + 50, n + 1)):
                seeded.add(2 * k + 1)
    got = {r.doc_id for r in S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(want) > 250 and seeded <= got <= want
    assert len(got & want) >= 0.99 * len(want)


def test_a_passage_grows_until_identity_fails(spark):
    rng = random.Random(8)
    one = words(rng, 700, "p")
    two = [f"z{k}" if k % 7 == 3 and k > 8 else w for k, w in enumerate(one)]
    rows = [(1, " ".join(words(rng, 700, "a") + one + words(rng, 700, "b"))), (2, " ".join(words(rng, 700, "c") + two + words(rng, 700, "d")))]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start, r.source_start) for r in got] == [(2, 700, 700)] and got[0].end in range(1396, 1401)


def test_empty_table_and_other_columns(spark):
    text = " ".join(f"w{k}" for k in range(70))
    docs = spark.createDataFrame([(1, text, 1, "x"), (1, text, 1, "x"), (None, text, 1, "x"), (2, text, 1, "x")], "doc_id long, text string, seed int, node string")
    assert [(r.doc_id, r.kind) for r in S.repeated_passages(docs).collect()] == [(2, "copy")]
    assert S.repeated_passages(docs.where("false")).collect() == []


def test_passages_within_one_text(spark):
    rng = random.Random(9)
    one, line = words(rng, 60, "p"), words(rng, 12, "l")
    rows = [(1, " ".join(words(rng, 40, "a") + one + words(rng, 90, "b") + one + words(rng, 20, "c"))), (2, " ".join(line * 40)), (3, " ".join(words(rng, 200, "d")))]
    got = {(r.doc_id, r.kind, r.start, r.end, r.source_start) for r in S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "within", 190, 250, 40), (2, "within", 12, 480, 0)}


def test_a_doc_id_with_two_texts(spark):
    rng = random.Random(10)
    one, two = words(rng, 70, "p"), words(rng, 70, "q")
    rows = [(1, " ".join(one)), (2, " ".join(two)), (5, " ".join(words(rng, 30, "a") + one)), (5, " ".join(words(rng, 30, "b") + two)), (5, " ".join(one))]
    got = {(r.doc_id, r.kind, r.start, r.end, r.source_doc) for r in S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, "passage", 30, 100, 1), (5, "passage", 30, 100, 2), (5, "copy", 0, 70, 1)}


def test_every_exact_passage_of_a_table_is_covered(spark):
    """The query on a whole table against brute force: words in runs of 60 words that stand elsewhere before are in passages."""
    docs = {r.doc_id: (r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    split = {i: [w for w in S_WORDS.split(t.translate(LOWER)) if w] for i, t in docs.items()}
    seen: set = set()
    must = {}
    for i in sorted(split):
        w = split[i]
        hits = set()
        for k in range(len(w) - 59):
            g = tuple(w[k : k + 60])
            if g in seen:
                hits |= set(range(k, k + 60))
            seen.add(g)
        if hits:
            must[i] = hits
    found: dict = {}
    for r in S.op3_substring_dedup(spark, "/root/testdata/sf0.001").collect():
        found.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        a, b = split[r.doc_id][r.start : r.end], split[r.source_doc][r.source_start : r.source_end]
        assert S.common(numbers(a), numbers(b)) >= r.n_equal >= 0.8 * max(len(a), len(b))
    assert len(must) > 10 and all(len(h & found.get(i, set())) >= 0.99 * len(h) for i, h in must.items())


def test_what_is_hopeless_has_no_piece():
    rng = random.Random(11)
    n_hopeless = 0
    for _ in range(400):
        one = [rng.randrange(40) for _ in range(70)]
        two = [w if rng.random() < rng.choice([0.2, 0.6, 0.8]) else rng.randrange(40) for w in one]
        if rng.random() < 0.5:
            del two[rng.randrange(20)]
        p = 30
        q = rng.randrange(25, 35)
        two[q : q + 6] = one[p : p + 6]
        a, b = np.array(one, np.uint32), np.array(two, np.uint32)
        left, right = (a[None, p - 24 : p][:, ::-1].astype(np.int64), b[None, q - 24 : q][:, ::-1].astype(np.int64)), (a[None, p + 6 : p + 30].astype(np.int64), b[None, q + 6 : q + 30].astype(np.int64))
        for x, y in (left, right):
            assert S.shared_by_prefix(x, y)[0].tolist() == [S.common(x[0, :i], y[0]) for i in range(25)]
        if S.hopeless(left, right, np.array([6]))[0]:
            n_hopeless += 1
            for x in S.align(a[p - 24 : p + 30], b[q - 24 : q + 30], [24], [24], [6], [1]):
                assert x[1] - x[0] < S.MIN_PIECE or x[4] < 0.8 * max(x[1] - x[0], x[3] - x[2]) or not x[0] <= 24 < x[1]
    assert n_hopeless > 50


def test_a_chain_with_all_common_grams():
    rng = random.Random(12)
    one = [rng.randrange(10**6) for _ in range(3000)]
    two = list(one)
    for k in range(1000, 2000, 9):
        two[k] = rng.randrange(10**6)
    del two[1500:1510]
    two[:1000], two[1990:] = [rng.randrange(10**6) for _ in range(1000)], [rng.randrange(10**6) for _ in range(900)]
    a, b = np.array(one, np.uint32), np.array(two, np.uint32)
    a_lo, b_lo, x, y, pos, there, length, seeds = S.denser(a, b, [1101], [1101], [6], [1])
    assert (a_lo, b_lo) == (1001 - 320, 1001 - 320) and len(x) < 1700
    assert all((x[p : p + n] == y[q : q + n]).all() for p, q, n in zip(pos, there, length)) and pos == sorted(pos) and there == sorted(there)
    lo, hi, lo2, hi2, equal, _ = max(S.align(x, y, pos, there, length, seeds), key=lambda z: z[1] - z[0])
    assert lo + a_lo <= 1001 and hi + a_lo >= 1999 and equal >= 850


@pytest.mark.parametrize("parts", [1, 4])
def test_parts_of_a_passage_in_earlier_texts_hide_nothing(spark, parts):
    """An 80-word passage in two texts, and thirteen earlier texts that each have 14 words of it."""
    rng = random.Random(9)
    noise = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join(noise(40) + passage[5 * i : 5 * i + 14] + noise(40))) for i in range(13)]
    rows += [(100 + i, " ".join(noise(60) + passage + noise(60))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    found = {(r.doc_id, r.source_doc): (r.start, r.end) for r in S.repeated_passages(docs).collect()}
    assert {(101, 100), (102, 101)} <= found.keys() and all(a <= 62 and b >= 138 for (d, s), (a, b) in found.items() if d > 100)
