"""op12: base spans against the plain patterns, the added ones by planted cases."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemosia.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def holds(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        return 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind == 0 or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if holds(k, m.group())]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(alphabet="a@.-%1", max_size=24), st.text(alphabet="12.0a", max_size=30), st.text(alphabet="04 -.+()", max_size=40)))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "a.b" * 100_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "1 " * 150_000, "Aa Bb " * 50_000, "a@b." * 70_000, "anna(at)" * 40_000):
        base = pii.base_spans(text)
        pii.candidates(text, base)


PLAIN = "the report of the {0} {1} was read and the committee agreed on it after some talk about costs"
RECORD = "{3} please contact {0} by mail {1} or phone {2} for the order that was placed last week"
NAMES = ["Anna Schmidt", "John Miller", "Maria Lopez", "Peter Brown", "Laura Weber"]


def corpus():
    rows = []
    for i in range(300):
        rows.append((i, PLAIN.format(i % 7, "budget version 1.2.3"), "en", "a"))
    for i in range(120):
        phone = f"+49 30 {1000000 + 7919 * i}" if i % 2 else f"(555) {100 + i}-{1000 + i}"
        rows.append((1000 + i, RECORD.format(NAMES[i % 5], f"user{i}@mail{i % 3}.example.com", phone, "Dear" if i % 3 else "Hello"), "en", "b"))
    rows += [(2000, None, "en", "a"), (2001, "", "en", "a"), (2002, "x" * 50_000 + " a@b.de", None, None), (2000, None, "en", "a")]
    return rows


def test_spans(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, base long, `a.b` string").repartition(3)
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows) and set(got[0].row.asDict()) == {"doc_id", "lang", "source", "base", "a.b"}
    texts = {i: t or "" for i, t, *_ in rows}
    added = {k: 0 for k in range(5)}
    for r in got:
        text = texts[r.row.doc_id]
        base, spans = [tuple(s) for s in r.base], [tuple(s) for s in r.spans]
        assert base == brute(text) and set(base) <= set(spans) and spans == sorted(spans)
        for k, b, e in set(spans) - set(base):
            added[k] += 1
        if r.row.doc_id < 300:
            assert not spans, text
    assert added[4] >= 110 and added[3] >= 55  # names after a word that calls for one, telephones without a +


def test_probabilities_order_labelers():
    """Labeler 0 is always right, labeler 6 is chance: EM tells them apart without labels."""
    rng = np.random.default_rng(5)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        vote = lambda right: int((1 if truth else -1) * (1 if rng.random() < right else -1))
        cast = (vote(0.98), vote(0.9), vote(0.85), vote(0.8), 0, 0, vote(0.5))
        counts[1, pii._code(cast)] = counts.get((1, pii._code(cast)), 0) + 1
    chance, tables = pii.weigh(counts)
    right = [(tables[1][1, j, 2] - tables[1][0, j, 2]) for j in range(7)]
    assert right[0] > right[1] > right[3] > abs(right[6]) and abs(right[6]) < 0.25
    assert chance[1, pii._code((1, 1, 1, 1, 0, 0, -1))] > 0.9 > 0.1 > chance[1, pii._code((-1, -1, -1, -1, 0, 0, 1))]


def test_classifier_learns_held_out():
    rng = np.random.default_rng(6)
    rows = [[int(rng.integers(0, 50)), 100 + int(y), 200] for y in rng.random(2000) < 0.4]
    target = np.array([float(r[1] == 101) for r in rows])
    w = pii.learn(rows[:1500], target[:1500] * 0.9 + 0.05, np.ones(1500))
    assert np.mean([(w[r].sum() > 0) == (t > 0) for r, t in zip(rows[1500:], target[1500:])]) > 0.99


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "no data here"), (2, "")]])
def test_without_candidates(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [list(r.spans) for r in pii.find_pii(df).collect()] == [[]] * len(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op12_pii(spark, sf).collect():
        base = brute(texts[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{b}:{e}" for k, b, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
