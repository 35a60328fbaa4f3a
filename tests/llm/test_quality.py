"""The rule ledger against plain Python."""

import random
import re

from mnemosia.llm import quality as Q

TEXTS = [
    None, "", " \n\t\n", "one", "a b c d e f g h " * 10, "x " * 15, "line one\nline two\nline one\n\n \nline one", "é 中文\x85 \U0001f600 #*$%&|<>", "a\x0bb\x0cc\rd", "nul\x00 in it",
    "same line\n" * 40 + "w1 w2 w3 w4 w5 w6 w7 w8 w9", "\n".join(f"word{k}" for k in range(300)), "y" * 70000 + " z",
]


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    seen: dict = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = {k + d for k, g in enumerate(grams) if seen[g] > 1 for d in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(lines)


def test_measures(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choices("abc", k=rng.randrange(60))) for _ in range(60)] + ["\n".join(" ".join(rng.choices("ab", k=rng.randrange(4))) for _ in range(20)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(0, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), *[r[m] for m in Q.MEASURES]) for r in Q.rule_ledger(docs).collect()))
    assert got == sorted((str(i), *plain(t)) for i, t in rows)


def test_policies_and_ablations(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ledger = Q.rule_ledger(docs)
    rows = ledger.collect()
    got = {r.rule: (r.n_failed, r.n_only, r.kept_without) for r in Q.ablations(ledger, "v1").collect()}
    whole = Q.mask("v1")
    for name in Q.POLICIES["v1"]:
        bit = Q.BIT[name]
        assert got[name] == (sum(bool(r.fail_bits & bit) for r in rows), sum(r.fail_bits & whole == bit for r in rows), sum(not r.fail_bits & whole & ~bit for r in rows))


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "x"), (2, " ".join(f"some{k}" for k in range(30)), 1, "x")], "doc_id long, text string, n_words int, fail_bits string")
    assert sorted(r.n_words for r in Q.rule_ledger(docs).collect()) == [2, 30]
    assert Q.rule_ledger(docs.where("false")).collect() == []
    kept = Q.quality_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [2]


def test_ablations_of_the_stored_ledger(spark):
    from mnemosia.llm.common import table

    ledger = [r.fail_bits for r in Q.rule_ledger(table(spark, "/root/testdata/sf0.001", "documents")).collect()]
    got = {(r.policy, r.rule): (r.n_failed, r.n_only, r.kept_without, r.kept) for r in Q.quality_ablations(spark, "/root/testdata/sf0.001").collect()}
    for policy, rules in Q.POLICIES.items():
        m = Q.mask(policy)
        for rule in rules:
            bit = Q.BIT[rule]
            assert got[policy, rule] == (sum(b & bit > 0 for b in ledger), sum(b & m == bit for b in ledger), sum(b & m & ~bit == 0 for b in ledger), sum(b & m == 0 for b in ledger))
    assert len(got) == sum(map(len, Q.POLICIES.values()))
    assert {r.policy: r.mask for r in Q.policy_table(spark).collect()} == {p: Q.mask(p) for p in Q.POLICIES}
