"""MinHash near-duplicates by an inverted join of signature coordinates.

Every text's set of word shingles gets a signature of K minima. Equal sets are
one class. A class is posted under each (coordinate, value) pair. Two classes
can share T or more of the K pairs only if they share one within their first
K - T + 1 pairs in order of rising frequency (prefix merging), and a class with
fewer than T pairs that any other class has cannot be linked at all (skipped). The full sets then
tell how many of a class's shingles any other such class has; that bounds its
intersections, exactly, and takes out classes and pairs that cannot reach 0.8.

Pairs are not enumerated within a group. First, classes are offered one link
each to a class they share postings with, links are confirmed on the full
shingle sets, and connected components are formed; this repeats a few times.
Then the classes that still share postings with other components are compared on
their full sets, rarest shingles first, without a probability. A pair within one component needs no look,
since it cannot change the components, so nothing is lost by this order.

With K = 64 and T = 36, a pair of similarity 0.8 is missed with probability 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, small, stored, table
from .textnp import Texts, mix, ngrams

K, T = 64, 36
SHINGLE = 4
SIMILAR = (80, 100)
#: Most rounds in which a class is offered a few links, and how many; what remains is compared pair by pair.
ROUNDS, OFFERS = 4, 16
#: Postings of a common shingle that meet the others in one task.
DEALT = 2_000
_U = np.uint64


@lru_cache(maxsize=1)
def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=_U))
    return seeds[:k] | _U(1), seeds[k:]


def _signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """The upper 32 bits of the least value of each of k hash functions."""
    a, b = _coefficients(k)
    least = np.full(k, 2**64 - 1, _U)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * a + b
        np.minimum(least, (part ^ (part >> _U(29))).min(axis=0), out=least)
    return (least >> _U(32)).astype(np.uint32)


def shingle_sets(texts: Texts, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than n words has one for all its words."""
    starts, ends, first = texts.words()
    words = texts.hashes(starts, ends)
    for i in range(texts.n):
        own = words[first[i] : first[i + 1]]
        yield np.unique(ngrams(own, n if len(own) >= n else len(own))) if len(own) else own


def _signatures(k: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in Texts.slices(batch.column(1), lower=True):
                size, f1, f2, sig = [], [], [], []
                for s in shingle_sets(texts, n):
                    size.append(len(s))
                    f1.append(int(np.add.reduce(mix(s), dtype=_U).astype(np.int64)) if len(s) else 0)
                    f2.append(int(np.add.reduce(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)), dtype=_U).astype(np.int64)) if len(s) else 0)
                    sig.append(_signature(s, k).view(np.int32) if len(s) else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in sig])]).astype(np.int32), pa.array(np.concatenate(sig) if sig else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists], ["doc_id", "n_shingles", "f1", "f2", "sig"])

    return run


def _marked(n: int):
    """(doc_id, text) -> both, n_shingles, f1, f2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for signed in _signatures(1, n)([batch]):
                text = batch.column(1).slice(at, signed.num_rows)
                yield pa.RecordBatch.from_arrays([signed.column(0), text, *signed.columns[1:4]], ["doc_id", "text", *signed.schema.names[1:4]])
                at += signed.num_rows

    return run


def signatures(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (together a 128-bit fingerprint of the set), sig, for each row of docs (doc_id, text)."""
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), _signatures(k, n), "doc_id long, n_shingles long, f1 long, f2 long, sig array<int>")


def prefix_postings(classes: DataFrame, k: int, t: int) -> DataFrame:
    """node, n, key: the postings of a class that must be looked at, rarest first."""
    pairs = stored(classes.select("node", "n", F.posexplode("sig").alias("coordinate", "value")).select("node", "n", F.shiftleft(F.col("coordinate").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key")), "pairs")
    counts = pairs.groupBy("key").agg(F.count("*").alias("freq")).where("freq > 1")
    shared = pairs.join(counts, "key")
    own = Window.partitionBy("node")
    ranked = shared.withColumn("shared", F.count("*").over(own)).where(F.col("shared") >= t).withColumn("rank", F.row_number().over(own.orderBy("freq", "key")))
    # pairs that no other class has come first in the order, so they use up the rest of the prefix
    return ranked.where(F.col("rank") <= F.col("shared") - t + 1).select("node", "n", "key")


def _spread(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in Texts.slices(batch.column(1), lower=True):
                sets = list(shingle_sets(texts, n))
                nodes = np.repeat(batch.column(0).slice(at, end - at).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets).astype(np.int64))], ["node", "h"])

    return run


def shared_counts(texts: DataFrame, n: int = SHINGLE) -> DataFrame:
    """node, s: how many of its shingles any other text of texts (node, text) has too."""
    rows = arrow_map(texts.select("node", "text"), _spread(n), "node long, h long")
    often = rows.groupBy("h").agg(F.count("*").alias("freq")).where("freq > 1").select("h")
    return rows.join(often, "h").groupBy("node").agg(F.count("*").alias("s"))


def _confirm(n: int):
    need, of = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left = [s for _, _, x in Texts.slices(part.column(1), lower=True) for s in shingle_sets(x, n)]
                ok = []
                for i, (b, s) in enumerate(zip(part.column(2).to_pylist(), left)):
                    if last[0] != b:
                        last = (b, next(r for _, _, x in Texts.slices(part.column(3).slice(i, 1), lower=True) for r in shingle_sets(x, n)))
                    both = len(np.intersect1d(s, last[1], assume_unique=True))
                    ok.append(of * both >= need * (len(s) + len(last[1]) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, n: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; texts has node, text of every class in pairs."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    return arrow_map(both.select("a", "left", "b", "right"), _confirm(n), "a long, b long, ok boolean").where("ok").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node reachable over the undirected edges (a, b), for every node in them.

    In a round every node points to its least neighbour, or to itself if it is less; pointers are followed twice more,
    and the edges between what they lead to are the next round's. So edges within a component are not read again: the
    nodes that are left are at most half as many after two rounds."""
    edges = _pairs(edges)
    hooks = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node"), "hooks")
        twice = to.alias("x").join(to.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", "y.to")
        hooks.append(stored(twice.alias("x").join(to.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", "y.to"), "hooks"))
        edges = _pairs(_led(edges, hooks[-1]))
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    labels = hooks[0].select("node", F.col("to").alias("comp"))
    for to in hooks[1:]:
        labels = labels.join(small(to.select(F.col("node").alias("comp"), "to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return stored(labels, "labels")


def _pairs(edges: DataFrame) -> DataFrame:
    """Each edge between two nodes once, with a < b."""
    return stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def _led(edges: DataFrame, to: DataFrame) -> DataFrame:
    """edges between the nodes to which `to` (node, to) leads their ends; an end that it lacks stays."""
    to = small(to)
    end = lambda c: to.select(F.col("node").alias(c), F.col("to").alias(f"_{c}"))
    return edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, comp) after further links (a, b): only these are followed, between the components they join."""
    if labels is None:
        return components(links)
    more = components(_led(links, labels.select("node", F.col("comp").alias("to"))))
    known = labels.select("node", "comp").unionByName(more.select("node", F.col("node").alias("comp")).join(small(labels.select("node")), "node", "left_anti"))
    out = known.join(small(more.select(F.col("node").alias("comp"), F.col("comp").alias("to"))), "comp", "left")
    return stored(out.select("node", F.coalesce("to", "comp").alias("comp")), "labels")


def _relabel(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("comp", F.col("node"))
    return postings.join(small(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _fits(n: str, s: str, m: str, r: str):
    """Whether sets of n and m shingles, of which s and r are shared with anyone, can be similar
    enough: their intersection must reach need / (need + of) of n + m, and is at most s and r."""
    need, of = SIMILAR
    return F.least(s, r) * (need + of) >= need * (F.col(n) + F.col(m))


def _offers(postings: DataFrame, turn: int) -> DataFrame:
    """a, b: for each class the few classes of other components with which it shares the most lists.

    A list offers one member, and to that one's component another: at first of the least and the greatest
    component, then any member, which in a large component is often its own, and a new one in every turn and list."""
    by = lambda c, *of: F.xxhash64(F.lit(turn), *of) if turn else F.col(c)
    row = ["comp", "node", "n", "s"]
    one = F.struct(by("comp", "node", "key").alias("x"), *row)
    other = F.struct(by("comp", "comp").alias("x"), *row)
    ends = postings.groupBy("key").agg(F.min(one).alias("lo"), F.max(other).alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    met = postings.join(ends.drop("c0", "c1"), "key").withColumn("other", F.when(F.col("comp") != F.col("lo.comp"), F.col("lo")).when(F.col("comp") != F.col("hi.comp"), F.col("hi"))).where("other IS NOT NULL")
    met = met.select("node", "n", "s", F.col("other.node").alias("b"), F.col("other.n").alias("m"), F.col("other.s").alias("r")).where(_fits("n", "s", "m", "r"))
    votes = met.groupBy("node", "b").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "b"))), 1, OFFERS if turn else 1).alias("best"))
    return best.select(F.col("node").alias("a"), F.explode("best.b").alias("b"))


def _rest(postings: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """a, b: every pair of classes in different components that may still be similar enough.

    Classes whose lists hold several components are compared on their full sets, in order of
    rising frequency. What follows the first shingle that two sets share, with it, is at least
    their intersection: 0.8 of the larger set, and 8/9 of the smaller. So the smaller set is
    posted under its first ninth only (`index`), the larger under its first fifth, and texts that
    are a little less alike than 0.8 do not meet in the lists of what all of them share. In each
    list the members outside its largest component meet all members; long lists are dealt in blocks."""
    need, of = SIMILAR
    lists = postings.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    nodes = stored(postings.join(lists, "key").select("node", "n", "comp").distinct(), "residue")
    rows = arrow_map(texts.join(small(nodes.select("node")), "node", "left_semi").select("node", "text"), _spread(n), "node long, h long")
    rows = stored(rows, "sets")
    often = rows.groupBy("h").agg(F.count("*").alias("freq")).where("freq > 1")
    ranked = rows.join(often, "h").join(small(nodes), "node")
    own = Window.partitionBy("node")
    # shingles that no other class has come first in the order
    ranked = ranked.withColumn("s", F.count("*").over(own) - F.row_number().over(own.orderBy("freq", "h")) + 1)
    index = F.col("s") * (need + of) >= F.col("n") * 2 * need
    prefix = stored(ranked.where(F.col("s") * of >= F.col("n") * need).select("h", "node", "n", "comp", "s", index.alias("index")), "prefix")
    sizes = prefix.groupBy("h", "comp").agg(F.count("*").alias("size"), F.count_if("index").alias("posted"))
    major = sizes.groupBy("h").agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("posted").alias("posted")).where("comps > 1 AND posted > 0")
    live = stored(prefix.join(major.select("h", F.col("top.comp").alias("major"), F.ceil(F.col("posted") / DEALT).cast("long").alias("blocks")), "h"), "lists")
    small_side = live.where("index").select("h", F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.col("node").alias("a"), "n", "s", F.col("comp").alias("own"), (F.col("comp") == F.col("major")).alias("mine"))
    large_side = live.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large_side = large_side.select("h", "block", F.col("node").alias("b"), F.col("n").alias("m"), F.col("s").alias("r"), "comp", (F.col("comp") == F.col("major")).alias("theirs"))
    ordered = (F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("a") < F.col("b"))
    met = lambda x, y: x.drop("mine").join(y.drop("theirs"), ["h", "block"]).where(ordered & (F.col("own") != F.col("comp")) & _fits("n", "s", "m", "r"))
    pairs = met(small_side.where("NOT mine"), large_side).unionByName(met(small_side.where("mine"), large_side.where("NOT theirs")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = K, t: int = T, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Words are split at space and \\x09-\\x0D after lower-casing A-Z. component_id is
    the least doc_id reachable over links of 100 * intersection >= 80 * union. A text
    without words links with nothing, however long the others are. Rows that share a doc_id belong
    together, so that texts of one doc_id link the components of all of them; a null
    doc_id with words takes its class's component, or null, and links nothing by itself. `kept` marks the
    document that stays of each component."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    key = ["f1", "f2", "n_shingles"]
    signed = stored(signatures(docs, k, n), "signatures")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("doc"), F.any_value("sig").alias("sig")).where("doc IS NOT NULL")
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    repeated = full.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi"))
    repeated = stored(repeated.where("rows > 1").select("doc_id", (F.col("lo") != F.col("hi")).alias("several")), "repeated")
    several = repeated.where("several").select("doc_id")
    any_repeated, any_several = not repeated.isEmpty(), not several.isEmpty()
    labels = None
    if any_several:
        # the classes of one doc_id's texts are linked
        met = full.join(small(several), "doc_id").select("doc_id", *key).distinct().join(classes.select("node", *key), key).select("doc_id", "node")
        links = stored(met.join(met.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "links")
        labels = components(links)
    postings = stored(prefix_postings(classes.select("node", F.col("n_shingles").alias("n"), "sig"), k, t), "postings")
    live = stored(classes.join(postings.select("node").distinct(), "node", "left_semi").select("node", F.col("doc").alias("doc_id"), *key), "live")
    if not live.isEmpty():
        one = live if not any_several else live.join(small(several), "doc_id", "left_anti")
        texts = docs.join(small(one.select("node", "doc_id")), "doc_id").select("node", "text")
        if any_several:
            own = arrow_map(docs.join(small(several), "doc_id", "left_semi"), _marked(n), "doc_id long, text string, n_shingles long, f1 long, f2 long")
            texts = texts.unionByName(own.join(live, ["doc_id", *key]).select("node", "text"))
        texts = stored(texts.dropDuplicates(["node"]) if any_repeated else texts, "texts")
        need, of = SIMILAR
        shared = stored(shared_counts(texts, n), "shared")
        postings = stored(postings.join(small(shared), "node").where(F.col("s") * of >= F.col("n") * need), "postings")
        dry = False
        for turn in range(ROUNDS + 1):
            marked = _relabel(postings, labels)
            offered = _offers(marked, turn) if turn < ROUNDS and not dry else _rest(marked, texts, n)
            new = stored(confirmed(offered, texts, n), "links")
            if new.isEmpty():
                if turn < ROUNDS and not dry:
                    dry = turn > 0
                    continue
                break
            labels = extended(labels, new)
            if dry:
                break
    named = classes.select("node", "doc", *key)
    if labels is not None:
        marked = named.join(small(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = labels.join(named.select("node", "doc"), "node").groupBy("comp").agg(F.min("doc").alias("least"))
        named = marked.join(small(stored(least, "least")), "comp", "left").select(*key, F.coalesce("least", "doc").alias("comp"))
    else:
        named = named.select(*key, F.col("doc").alias("comp"))
    found = signed.select("doc_id", *key).join(named, key, "left")
    component = F.coalesce("comp", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the one with its least doc_id (of equal doc_ids one row); rows with a null doc_id stay."""
    found = near_duplicates(docs)
    drop = stored(found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    # the document's own columns stay in one struct, whatever their names
    whole = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    unique = whole.join(small(drop), "_id", "left_anti")
    again = stored(found.where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"), "repeated")
    if again.isEmpty():
        return unique.select("row.*")
    again = small(again)
    # tasks choose among their own rows first: the least text of each doc_id
    one = unique.join(again, "_id", "left_semi").groupBy("_id").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return unique.join(again, "_id", "left_anti").select("row.*").unionByName(one.select("row.*"))
