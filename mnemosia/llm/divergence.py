"""Source divergence audit by inclusion-exclusion over supports.

A language's groups are its sources. Every group gives each kept term of the language a share p, also the terms that it
does not have, all of which get the same share z. So the sum over all terms of abs(p_a - p_b) needs no row for a term
that neither has: terms of a alone and of b alone are priced against the other's z from the histogram of counts of each
group, terms that both have are then put right by a join of the sparse postings (abs(p_a - p_b) - abs(p_a - z_b) -
abs(z_a - p_b) + abs(z_a - z_b)), and the rest is a constant times abs(z_a - z_b).

Texts are counted in tasks, per group and term, in tables of bounded size, so a source with a third of all rows sends
as much as any other. All shares are integers, from decimals, so the sums are exact and do not depend on the order.

Defined results: null text, lang and source are ''. A text without terms, a language without kept terms and a group
without kept terms keep their groups: values are then 0, or the constant shares. A language of one source has no rows
of part `pair`. Ties are ranked by the item's bytes. Repeated rows count as often as they stand there. An empty table
gives no row. Counts, lists and texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, small, stored, table
from .textnp import Texts

#: Documents of a language that a kept term is in, at least; the addend of counts; the unit of shares; ranks of terms that are shown.
MIN_DOCS, ADDEND, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text that a task counts at once (one longer batch is taken whole).
HELD_BYTES = 4_000_000
#: Bytes that stand between terms: all ASCII but letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _counted(rows: pa.Table) -> pa.RecordBatch:
    """The terms of rows (lang, source, text), by language: documents that have one, and its occurrences by source.

    Rows are put in the order of their groups, and a stable sort by the terms' hashes keeps that order, so that equal
    terms, languages, sources and documents each are neighbours."""
    rows = rows.sort_by([("lang", "ascending"), ("source", "ascending")])
    ids = {c: rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")}
    lang, source = (np.asarray(ids[c].indices) for c in ("lang", "source"))
    column = rows.column("text").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    texts = Texts(buf, offsets - offsets[0], lower=True)
    starts, ends, first = texts.words(_BETWEEN)
    hashes = texts.hashes(starts, ends)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]

    def changes(of: np.ndarray, outer: np.ndarray) -> np.ndarray:
        out = outer.copy()
        out[1:] |= of[1:] != of[:-1]
        return out

    by_lang = changes(lang[doc], new)
    by_group = changes(source[doc], by_lang)
    by_doc = changes(doc, by_group)
    heads, groups = np.flatnonzero(by_lang), np.flatnonzero(by_group)
    docs = np.diff(np.append(np.cumsum(by_doc)[heads] - 1, by_doc.sum()))
    counts = np.diff(np.append(groups, len(order)))
    own = order[heads]
    lengths = ends[own] - starts[own]
    upto = np.concatenate([[0], np.cumsum(lengths)])
    spelled = texts.buf[np.arange(upto[-1]) + np.repeat(starts[own] - upto[:-1], lengths)]
    term = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(spelled)]).cast(pa.large_string()).cast(pa.string())
    entry = pa.StructArray.from_arrays([ids["source"].dictionary.take(pa.array(source[doc[groups]])), pa.array(counts, pa.int64())], ["source", "count"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(groups, heads), len(groups)), pa.int32()), entry)
    return pa.RecordBatch.from_arrays([ids["lang"].dictionary.take(pa.array(lang[doc[heads]])), term, pa.array(docs, pa.int64()), lists], ["lang", "term", "docs", "sources"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, term, docs, sources (array of source, count): partial counts, some rows for each term; docs: lang, source, text without nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size > HELD_BYTES:
                yield _counted(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield _counted(pa.Table.from_batches(held))

    return arrow_map(docs, count, "lang string, term string, docs long, sources array<struct<source:string,count:long>>")


def _share(count, total, terms):
    """1 + floor(UNIT * (count + ADDEND) / (total + ADDEND * terms)), by decimals; null where a language has no terms."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + ADDEND).cast("decimal(20,0)")
    low = (total + ADDEND * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", top, low) + 1)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups: lang, source, n, v, z, n_terms; postings: lang, source, term, count, p; terms: lang, term, count, q), all but the last stored."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = stored(term_counts(docs), "counts")
    often = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    often = stored(often, "often")
    # only kept terms are taken apart by source
    kept = counts.join(small(often), ["lang", "term"]).select("lang", "term", F.inline("sources"))
    kept = stored(kept.groupBy("lang", "source", "term").agg(F.sum("count").alias("count")), "kept")
    terms = kept.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    langs = kept.groupBy("lang").agg(F.sum("count").alias("total"), F.count_distinct("term").alias("v"))
    langs = stored(langs, "langs")
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("n_terms"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(small(langs.select("lang", "v")), "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "n_terms")])
    groups = stored(groups.withColumn("z", _share(F.lit(0), F.col("n"), F.col("v"))), "groups")
    postings = kept.join(small(groups.select("lang", "source", "n", "v")), ["lang", "source"])
    postings = stored(postings.select("lang", "source", "term", "count", _share(F.col("count"), F.col("n"), F.col("v")).alias("p")), "postings")
    shared = terms.join(small(langs), "lang").select("lang", "term", "count", _share(F.col("count"), F.col("total"), F.col("v")).alias("q"))
    return groups, postings, shared


def pair_divergences(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, other, value: the sum of abs(p - q) over all kept terms of the language, for each two of its sources, both ways."""
    side = lambda p: groups.select("lang", *[F.col(c).alias(f"{p}_{c}") for c in ("source", "v", "z", "n_terms")])
    pairs = side("a").join(side("b"), "lang").where("a_source <> b_source")
    # one side: the histogram of a's shares and every other z of the language, in one order, with running sums
    bars = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("many"))
    line = bars.select("lang", "source", F.col("p").alias("at"), "many", F.lit(None).cast("string").alias("other"))
    asked = pairs.select("lang", F.col("a_source").alias("source"), F.col("b_z").alias("at"), F.lit(0).cast("long").alias("many"), F.col("b_source").alias("other"))
    whole = Window.partitionBy("lang", "source")
    upto = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("at") * F.col("many")
    line = line.unionByName(asked.where("at IS NOT NULL")).select(
        "lang", "source", "other", "at", F.coalesce(F.sum("many").over(upto), F.lit(0)).alias("k"), F.coalesce(F.sum(mass).over(upto), F.lit(0)).alias("s"),
        F.sum("many").over(whole).alias("all_k"), F.sum(mass).over(whole).alias("all_s"),
    )
    alone = line.where("other IS NOT NULL").selectExpr("lang", "source", "other", "at * k - s + (all_s - s) - at * (all_k - k) AS value")
    # both sides: the postings of a term meet
    own = lambda p: postings.join(small(groups.select("lang", "source", "z")), ["lang", "source"]).select("lang", "term", F.col("source").alias(f"{p}_source"), F.col("p").alias(f"{p}_p"), F.col("z").alias(f"{p}_z"))
    met = own("a").join(own("b"), ["lang", "term"]).where("a_source < b_source")
    fixed = met.groupBy("lang", "a_source", "b_source").agg(
        F.sum(F.expr("abs(a_p - b_p) - abs(a_p - b_z) - abs(a_z - b_p) + abs(a_z - b_z)")).alias("fix")
    )
    both = fixed.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("other"), "fix").unionByName(fixed.select("lang", F.col("b_source").alias("source"), F.col("a_source").alias("other"), "fix"))
    rest = pairs.selectExpr("lang", "a_source AS source", "b_source AS other", "coalesce((a_v - a_n_terms - b_n_terms) * abs(a_z - b_z), 0) AS value")
    mirrored = alone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    parts = rest.unionByName(alone).unionByName(mirrored).unionByName(both.withColumnRenamed("fix", "value"))
    return parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def term_excesses(postings: DataFrame, shared: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, term, value, rank: the terms that a source uses more than its language, to rank top."""
    over = postings.join(small(shared.select("lang", "term", "q")), ["lang", "term"]).where("p > q")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return over.selectExpr("lang", "source", "term", "p - q AS value").withColumn("rank", rank).where(F.col("rank") <= top)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, postings, shared = audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))
    pairs = pair_divergences(groups, postings)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))
    first = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", rank.alias("rank"))
    return first.unionByName(term_excesses(postings, shared).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


ORACLE = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, source, i, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {ADDEND})) // (coalesce(s.n, 0) + {ADDEND} * v.v))::BIGINT AS p, (1 + ({UNIT}::HUGEINT * (k.n + {ADDEND})) // (v.n + {ADDEND} * v.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
b AS (SELECT x.lang, x.source, y.source AS item, coalesce(a.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
t AS (SELECT lang, source, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q QUALIFY rank <= {TOP})
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM b UNION ALL SELECT lang, source, 'term', item, value::BIGINT, rank::INTEGER FROM t"""
