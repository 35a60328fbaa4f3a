"""Base scores against plain counts; the model against its base on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mnemosia.llm import maxent as M
from mnemosia.llm.textnp import Texts


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + [None]


def plain(rows):
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(t for (_, x), h in zip(rows, held) if not h for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for (i, x), h in zip(rows, held)]


def grammar(n):
    """Texts in which a word tells much of the next one."""
    rng = random.Random(8)
    after = {k: rng.sample(range(60), 3) for k in range(60)}
    out = []
    for i in range(n):
        w, text = rng.randrange(60), []
        for _ in range(rng.randrange(200, 400)):
            text.append(f"w{w}")
            w = rng.choice(after[w])
        out.append((i, " ".join(text)))
    return out


@pytest.fixture(scope="module")
def rows():
    return grammar(120) + [(500, None), (501, ""), (502, "W1 w1 unseené"), (503, " ".join(f"rare{k}" for k in range(500))), (3, "twice")]


@pytest.mark.parametrize("hot", [M.HOT, 5])
def test_base_scores(spark, rows, hot):
    got = sorted(M.lm_score(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect())
    assert len(got) == len(rows)
    for r, e in zip(got, sorted(plain(rows))):
        assert tuple(r)[:5] == e[:5]
        assert r.base_score == pytest.approx(e[5], abs=1e-6)
        assert r.score < 0


def test_the_model_beats_its_base_on_held_out_texts(spark, rows):
    got = M.lm_score(spark.createDataFrame(rows[:120], "doc_id long, text string"), epochs=4).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) * 0.97


def test_probabilities_sum_to_one(spark, rows):
    """Over the classes by construction; over the words of each class by their masses."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = M.token_counts(docs)
    vocab = M.vocabulary(counts)
    all_counts = counts.toPandas()
    y = vocab.classes(all_counts["h"].to_numpy(), all_counts["ending"].to_numpy())
    sums = np.zeros(M.CLASSES)
    np.add.at(sums, y, all_counts["c"].to_numpy() + 0.5)
    sums[M.SINGLES :] += 0.5  # unknown words
    used = sums > 0
    assert np.allclose(np.log10(sums[used]), vocab.log_mass[used])
    weights = np.random.default_rng(1).normal(size=(9, M.CLASSES)).astype(np.float32)
    z = M.log_softmax(weights, np.zeros(M.CLASSES, np.float32), np.tile(np.array([[0], [2]]), M.CLASSES), np.arange(M.CLASSES))
    assert abs(np.exp(z).sum() - 1) < 1e-5


def test_histories_stay_within_a_text():
    h = np.arange(10, 16)
    whole = M.features(h, np.array([0, 3, 6]))
    assert (whole[:, 3:] == M.features(h[3:], np.array([0, 3]))).all()
    assert Texts is not None


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "x"), (1, "a b", 1, "x"), (None, "a", 1, "x")], "doc_id long, text string, n_tokens int, score string")
    assert sorted(r.n_tokens for r in M.lm_score(docs).collect()) == [2, 3, 3]
    assert M.lm_score(docs.where("false")).collect() == []
    assert [r.n_known for r in M.lm_score(spark.createDataFrame([(i, "a") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")).collect()][0] == 0


def test_scores_against_the_formula(spark, rows):
    """The score of each text by plain sums over classes and words, with the trained weights."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = docs.where(~M.held_out(docs.doc_id))
    counts = M.token_counts(learned)
    vocab = M.vocabulary(counts)
    model = M.train(learned, vocab)
    outer, inner = M._unpack(model, vocab.buckets)
    table = counts.toPandas()
    count = dict(zip(table["h"], table["c"]))
    rank = dict(zip(vocab.listed.tolist(), vocab.rank.tolist()))
    assert abs(outer).max() > 0.01 and abs(inner).max() > 0.01

    def prob(z, k):
        top = max(z)
        return math.exp(z[k] - top) / sum(math.exp(x - top) for x in z)

    got = {}
    for r in M.lm_score(docs).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    import pyarrow as pa

    for i, text in rows[:6] + rows[120:]:
        (_, _, texts), = Texts.slices(pa.array([text or ""]), lower=True)
        h, ending, bounds = M._tokens(texts)
        f = M.features(h, bounds, vocab.buckets)
        total = 0.0
        for k, (x, e) in enumerate(zip(h.tolist(), ending.tolist())):
            c = rank[x] // M.SLOTS if x in rank else e
            total += math.log10(prob([sum(float(outer[j, q]) for j in f[:, k]) + float(outer[-1, q]) for q in range(M.CLASSES)], c))
            if x in rank:
                g = M.inner_features(f[:, k : k + 1], np.array([c]), vocab.buckets)[:, 0]
                z = [float(vocab.prior[c, q]) + sum(float(inner[j, q]) for j in g) for q in range(M.SLOTS)]
                total += math.log10(prob(z, rank[x] % M.SLOTS))
            else:
                total += math.log10(count.get(x, 0) + 0.5) - vocab.log_mass[c]
        assert any(abs(total - s) < 1e-3 * max(1, abs(total)) for s in got[i])


def test_one_pass_learns_and_more_texts_teach_more(spark):
    """With the registered settings, the gain over the base on held-out texts, at two sizes, with one trainer and with eight, whose weights are averaged."""
    gains = {}
    for n, parts in ((150, 2), (600, 2), (150, 8), (600, 8)):
        docs = spark.createDataFrame(grammar(n), "doc_id long, text string").repartition(parts)
        held = M.lm_score(docs, share=1 if parts > 2 else M.SHARE).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
        gains[n, parts] = 1 - held[0] / held[1]
    assert gains[150, 2] > 0.05 and gains[600, 2] > gains[150, 2]
    assert gains[150, 8] > 0.05 and gains[600, 8] > gains[150, 8]


def test_features_grow_with_the_tokens():
    sizes = [M.Vocabulary(*[np.zeros(0)] * 6, tokens, 9).buckets for tokens in (0, 10**6, 10**8, 10**10, 10**14)]
    assert sizes == [M.BUCKETS, M.BUCKETS, 1 << 15, M.MOST_BUCKETS, M.MOST_BUCKETS]
