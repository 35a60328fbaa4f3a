"""LM scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class, history). The most frequent
words are listed in classes of SLOTS words by rank; every other word (known or not)
has the class that its last bytes hash to, so a class is a function of the word. The
class softmax sums the weights of hashed features of the history: the last word, the
last two words as one n-gram, and skip features (the second and the third last word
alone). Within a class of listed words a second softmax sums those of the last word
and of the last two, each with the class, onto the words' logarithmic frequencies;
within a class of endings, words have their smoothed relative frequency.

Word counts cover all training texts and are joined back by shuffle; only a
bounded table of the most frequent words is broadcast. The number of features and that of
the tasks that train grow with the square root of the tokens, the features up to a bound. The weights are trained by
distributed updates, in rounds of which each has its share of the texts: every task
starts from the current weights and takes minibatch AdaGrad steps, and each feature's
changes are averaged over the tasks by the tokens that had it, block by block in two
levels; so a feature that few tasks met keeps what they learned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, stored, table
from .textnp import Texts, mix

_U = np.uint64
#: Hash that stands for the end of a text.
END = int(mix(np.array([0x656E64], _U)).astype(np.int64)[0])
#: Most frequent words whose counts are broadcast: at most 12 bytes each.
HOT = 262_144
#: Classes: first those of listed words, then those of word endings; listed words of a class.
SINGLES, CLASSES, SLOTS = 8, 32, 64
#: Hashed features (rows of weights): about ROOTS times the square root of the training tokens, within these bounds; 100 MB of weights at most.
BUCKETS, MOST_BUCKETS, ROOTS = 1 << 12, 1 << 18, 4
#: Least training tokens of a task for each feature, so that what tasks send stays in proportion to the texts.
SHARE = 256
FEATURES, INNER = 4, 2
#: Shares of the texts after which the tasks' weights are averaged, and times that all texts are seen.
ROUNDS, EPOCHS = 3, 1
BATCH = 8192
RATE = 0.15
#: Rows of weights that are averaged in one piece.
BLOCK = 128
HELD_OUT = 1


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 1; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == HELD_OUT


def _tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending class, first) of all texts' tokens; each text ends with END."""
    starts, ends, first = texts.words()
    words = texts.hashes(starts, ends).astype(np.int64)
    tail = texts.hashes(np.maximum(starts, ends - 3), ends)
    ending = (SINGLES + (mix(tail) >> _U(20)) % _U(CLASSES - SINGLES)).astype(np.uint8)
    counts = np.diff(first) + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    h, c = np.full(bounds[-1], END, np.int64), np.full(bounds[-1], SINGLES, np.uint8)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    h[inner], c[inner] = words, ending
    return h, c, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, texts in Texts.slices(batch.column(0), lower=True):
            h, c, _ = _tokens(texts)
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c[at].astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "ending", "c"])


def token_counts(docs: DataFrame) -> DataFrame:
    """h, ending, c: every token's count over the texts of docs; tasks sum their own first."""
    return arrow_map(docs.select("text"), _count, "h long, ending int, c long").groupBy("h", "ending").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks need of the counts: the most frequent words, and totals by class."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    listed: np.ndarray  # the hashes of the listed words, sorted
    rank: np.ndarray  # their ranks: class rank // SLOTS, slot rank % SLOTS
    prior: np.ndarray  # SINGLES x SLOTS: natural log of a listed word's share of its class, -inf for free slots
    log_mass: np.ndarray  # log10 of each class's smoothed total
    tokens: int
    types: int

    @property
    def buckets(self) -> int:
        return min(MOST_BUCKETS, max(BUCKETS, 1 << round(math.log2(ROOTS * math.sqrt(max(1, self.tokens))))))

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """The rank of each listed word, else -1."""
        if not len(self.listed):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.listed, h), len(self.listed) - 1)
        return np.where(self.listed[at] == h, self.rank[at], -1)

    def classes(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        rank = self.ranks(h)
        return np.where(rank >= 0, rank // SLOTS, ending).astype(np.int64)

    def known(self, h: np.ndarray) -> np.ndarray:
        """Counts of the tokens among the most frequent words, else 0."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], 0)


def vocabulary(counts: DataFrame, hot: int = HOT) -> Vocabulary:
    """counts is a stored table. To the driver come `hot` rows at most and one row a class."""
    top = counts.orderBy(F.desc("c"), "h").limit(hot).select("h", "ending", "c").toArrow().to_pandas()
    by_class = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("types")).toArrow().to_pandas()
    mass, types = np.zeros(CLASSES), np.zeros(CLASSES)
    mass[by_class["ending"]], types[by_class["ending"]] = by_class["c"], by_class["types"]
    tokens, all_types = int(mass.sum()), int(types.sum())
    single = top.head(SINGLES * SLOTS)
    prior = np.full((SINGLES, SLOTS), -np.inf, np.float32)
    for k, (e, c) in enumerate(zip(single["ending"], single["c"])):
        mass[e] -= c
        types[e] -= 1
        mass[k // SLOTS] += c
        types[k // SLOTS] += 1
        prior[divmod(k, SLOTS)] = math.log(c + 0.5)
    # every class of endings also holds the unknown words with its endings, as one more type
    types[SINGLES:] += 1
    order, by = np.argsort(top["h"].to_numpy()), np.argsort(single["h"].to_numpy())
    with np.errstate(divide="ignore"):
        log_mass = np.log10(mass + 0.5 * types)
        prior -= np.where(np.isfinite(log_mass[:SINGLES, None]), log_mass[:SINGLES, None], 0) * math.log(10)
    return Vocabulary(top["h"].to_numpy()[order], top["c"].to_numpy()[order], single["h"].to_numpy()[by], by.astype(np.int64), prior, log_mass, tokens, all_types)


def features(h: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """FEATURES x tokens: rows of weights for each token's history; before a text stands END."""
    before = []
    place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    for k in (1, 2, 3):
        x = np.full(len(h), END, np.int64)
        x[k:] = h[:-k] if k < len(h) else x[k:]
        x[place < k] = END
        before.append(x.astype(_U))
    a, b, c = before
    keys = [a + _U(1), b * _U(3) + _U(2), c * _U(5) + _U(3), a * _U(0x9E3779B97F4A7C15) + b * _U(7) + _U(4)]
    return np.stack([(mix(k) & _U(buckets - 1)).astype(_rows(buckets)) for k in keys])


def _rows(buckets: int) -> type:
    """The type of row numbers; short ones are sorted by radix."""
    return np.uint16 if buckets <= 1 << 16 else np.int32


def inner_features(rows: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    """INNER x tokens: rows of the weights within classes, for the last word and for the last two, with the class."""
    own = y.astype(_U) * _U(0xD6E8FEB86659FD93)
    return np.stack([(mix(rows[k].astype(_U) * _U(3) + _U(k) + own) & _U(buckets - 1)).astype(_rows(buckets)) for k in (0, 3)])


def _logits(weights: np.ndarray, base: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """tokens x outputs: sums of the features' weights and base, less each token's largest."""
    z, other = np.take(weights, rows[0], axis=0), np.empty((rows.shape[1], weights.shape[1]), np.float32)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0, out=other, mode="clip")
    z += base
    z -= z.T.copy().max(axis=0)[:, None]
    return z


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The natural log of the probability of each token's own output y."""
    z = _logits(weights, bias, rows)
    own = z[np.arange(len(y)), y]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))


def _gradient(weights: np.ndarray, base: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    grad = _logits(weights, base, rows)
    np.exp(grad, out=grad)
    grad /= (grad @ np.ones(grad.shape[1], np.float32))[:, None]
    grad[np.arange(len(y)), y] -= 1
    return grad


def _descend(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """One AdaGrad step; `seen` sums each row's mean squared gradient."""
    size = np.float32(grad.shape[1])
    sorted_grad = np.empty_like(grad)
    for r in rows:
        order = np.argsort(r, kind="stable" if r.dtype == np.uint16 else None)
        own = r[order]
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        g = np.add.reduceat(np.take(grad, order, axis=0, out=sorted_grad, mode="clip"), at, axis=0)
        u = own[at]
        seen[u] += np.einsum("ij,ij->i", g, g) / size
        g *= (RATE / len(rows) * math.sqrt(size / 8) / np.sqrt(seen[u] * (size / 8) + np.float32(1)))[:, None].astype(np.float32)
        weights[u] -= g


def _unpack(model: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights of classes, the last row the bias; weights within classes)."""
    whole = np.frombuffer(model, np.float32)
    cut = (buckets + 1) * CLASSES
    return whole[:cut].reshape(buckets + 1, CLASSES), whole[cut:].reshape(buckets, SLOTS)


def _pieces(x: np.ndarray) -> list[np.ndarray]:
    return [x[k : k + BLOCK] for k in range(0, len(x), BLOCK)]


SUMS = "block int, part int, tokens binary, sums binary"


def _train(shared, parts: int):
    """Rows (block, part, tokens, changes): for every row of a block that was met, tokens (float32) and the change (float16)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        given = _unpack(model, vocab.buckets)
        outer, inner = (x.copy() for x in given)
        weights, bias = outer[:-1], outer[-1]
        seen, n = [np.zeros(len(x), np.float32) for x in given], [np.zeros(len(x), np.float32) for x in given]
        for batch in batches:
            for _, _, texts in Texts.slices(batch.column(0), lower=True):
                h, ending, bounds = _tokens(texts)
                rank = vocab.ranks(h)
                rows, y = features(h, bounds, vocab.buckets), np.where(rank >= 0, rank // SLOTS, ending).astype(np.int64)
                for at in range(0, len(h), BATCH):
                    r, c, slot = rows[:, at : at + BATCH], y[at : at + BATCH], rank[at : at + BATCH]
                    grad = _gradient(weights, bias, r, c)
                    bias -= RATE * grad.mean(axis=0)
                    _descend(weights, seen[0], r, grad)
                    n[0][:-1] += np.bincount(r.ravel(), minlength=len(weights))
                    listed = np.flatnonzero(slot >= 0)
                    if len(listed):
                        c, slot = c[listed], slot[listed] % SLOTS
                        r = inner_features(r[:, listed], c, vocab.buckets)
                        _descend(inner, seen[1], r, _gradient(inner, vocab.prior[c], r, slot))
                        n[1] += np.bincount(r.ravel(), minlength=len(inner))
                n[0][-1] += len(h)
        if n[0][-1]:
            part = TaskContext.get().partitionId() % parts
            changes = [(t, d) for x, old, m in zip((outer, inner), given, n) for t, d in zip(_pieces(m), _pieces((x - old).astype(np.float16)))]
            for at in range(0, len(changes), 64):
                some = changes[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(at, at + len(some)), pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array([t.tobytes() for t, _ in some], pa.binary()), pa.array([d.tobytes() for _, d in some], pa.binary())],
                    ["block", "part", "tokens", "sums"],
                )

    return run


def _add(first: bool):
    """Sums of a block's rows, one after the other; at first the changes are multiplied by their tokens. What is held is one
    row for each key of the partition, whatever the number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, part, t, d in zip(*(c.to_pylist() for c in batch.columns)):
                t = np.frombuffer(t, np.float32)
                d = np.frombuffer(d, np.float16 if first else np.float32).reshape(len(t), -1)
                d = d * t[:, None] if first else d
                old = held.get((block, part if first else 0))
                held[block, part if first else 0] = (t, d) if old is None else (old[0] + t, old[1] + d)
        for (block, part), (t, d) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([t.tobytes()], pa.binary()), pa.array([d.astype(np.float32).tobytes()], pa.binary())], ["block", "part", "tokens", "sums"])

    return run


def train(docs: DataFrame, vocab: Vocabulary, epochs: int = EPOCHS, share: int = SHARE) -> bytes:
    """The weights of docs (doc_id, text): (buckets + 1) x CLASSES as float32, the last row the bias, then buckets x SLOTS."""
    spark, buckets = docs.sparkSession, vocab.buckets
    outer, inner = np.zeros((buckets + 1, CLASSES), np.float32), np.zeros((buckets, SLOTS), np.float32)
    usable = np.isfinite(vocab.log_mass)
    trainers = math.ceil(max(1, vocab.tokens) / (share * buckets))
    parts = math.isqrt(trainers)  # pieces of the first level
    outer[-1, usable] = vocab.log_mass[usable] * math.log(10)
    for turn in range(ROUNDS * epochs):
        shared = spark.sparkContext.broadcast((vocab, outer.tobytes() + inner.tobytes()))
        some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn % ROUNDS)
        own = arrow_map(some.select("text").coalesce(trainers), _train(shared, parts), SUMS)
        some = own.repartition("block", "part").mapInArrow(_add(True), SUMS)
        done = some.repartition("block").mapInArrow(_add(False), SUMS).collect()
        pieces = _pieces(outer) + _pieces(inner)
        for r in done:  # as many rows as the model has blocks
            n = np.frombuffer(r.tokens, np.float32)[:, None]
            pieces[r.block] += np.frombuffer(r.sums, np.float32).reshape(len(n), -1) / np.maximum(n, 1)
        shared.unpersist()
    return outer.tobytes() + inner.tobytes()


def model_logs(vocab: Vocabulary, model: bytes, h: np.ndarray, ending: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of each token's probability, but for the frequency of words of endings' classes; whether it is a listed word)."""
    outer, inner = _unpack(model, vocab.buckets)
    rank, rows = vocab.ranks(h), features(h, bounds, vocab.buckets)
    y, p = np.where(rank >= 0, rank // SLOTS, ending).astype(np.int64), np.empty(len(h))
    for k in range(0, len(h), BATCH):
        r, c, slot = rows[:, k : k + BATCH], y[k : k + BATCH], rank[k : k + BATCH]
        own = log_softmax(outer[:-1], outer[-1], r, c) / math.log(10)
        listed = np.flatnonzero(slot >= 0)
        own = np.where(slot >= 0, own, own - vocab.log_mass[c])
        if len(listed):
            c, slot = c[listed], slot[listed] % SLOTS
            own[listed] += log_softmax(inner, vocab.prior[c], inner_features(r[:, listed], c, vocab.buckets), slot) / math.log(10)
        p[k : k + BATCH] = own
    return p, rank >= 0


def _score(shared):
    """Rows (doc_id, held_out, n_tokens, n_hot, hot_sum, model_sum, cold): sums of log10(c + 0.5) over
    frequent tokens, and of the model's terms over all less that of listed words; cold has the hashes of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        for batch in batches:
            for at, end, texts in Texts.slices(batch.column(2), lower=True):
                h, ending, bounds = _tokens(texts)
                c = vocab.known(h)
                hot = c > 0
                logs = np.where(hot, np.log10(c + 0.5), 0.0)
                p, listed = model_logs(vocab, model, h, ending, bounds)
                p -= np.where(listed, logs, 0.0)
                cold_at = np.concatenate([[0], np.cumsum(~hot)])[bounds]
                cold = pa.ListArray.from_arrays(pa.array(cold_at.astype(np.int32)), pa.array(h[~hot]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(np.diff(bounds)), pa.array(np.add.reduceat(hot.astype(np.int64), bounds[:-1])), pa.array(np.add.reduceat(logs, bounds[:-1])), pa.array(np.add.reduceat(p, bounds[:-1])), cold],
                    ["doc_id", "held_out", "n_tokens", "n_hot", "hot_sum", "model_sum", "cold"],
                )

    return run


def lm_score(docs: DataFrame, epochs: int = EPOCHS, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Null is the empty text, which has one token, its end. Repeated rows stay
    repeated and each counts in training. Without any training text every token
    is unknown. Tokens are told apart by 64-bit hashes."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    learned = docs.where("NOT held_out")
    counts = stored(token_counts(learned), "counts")
    vocab = vocabulary(counts, hot)
    shared = spark.sparkContext.broadcast((vocab, train(learned, vocab, epochs, share)))
    schema = "doc_id long, held_out boolean, n_tokens long, n_hot long, hot_sum double, model_sum double, cold array<long>"
    rows = stored(arrow_map(docs, _score(shared), schema).withColumn("row", F.monotonically_increasing_id()), "rows")
    # the other tokens meet their counts in a shuffle; a text's repeats of one go as one row
    cold = rows.select("row", F.explode("cold").alias("h")).groupBy("row", "h").agg(F.count("*").alias("n"))
    met = cold.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("cold_sum"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_cold"))
    logs = F.col("hot_sum") + F.coalesce("cold_sum", F.lit(0.0))
    base = math.log10(vocab.tokens + 0.5 * (vocab.types + 1))
    return rows.drop("cold").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_hot") + F.coalesce("n_cold", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (logs + F.col("model_sum")).alias("score"),
    )


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
