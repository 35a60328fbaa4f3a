"""Benchmark decontamination: a positional inverted index of the documents.

Every test item is cut into windows of consecutive words. A window is looked up
through its rarest terms: the index holds postings (term, document, position) of
those terms, in files dealt by document. The list of a window's rarest term
gives start positions; each further probe term, its positions shifted by its
offset in the window, thins them out. What is left is compared word by word with
the document, so the matches are exact phrases. `near_matches` uses the same
postings for the proximity of a set of terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, small, stored, table

WINDOW = 10
#: Terms of a window that are looked up, rarest first.
PROBES = 2
#: Bytes of candidates up to which they are broadcast to the documents; beyond that, both are shuffled.
BROADCAST_BYTES = 64 << 20
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text after lower-casing A-Z: runs of digits, a-z and characters from \\x80 on."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def windows(items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(phrases, owners) of items (item_id, text), both stored.

    phrases: window_id, phrase (words joined by a space), n (words), terms; each
    distinct phrase once. owners: window_id, item_id, distinct. Items without words have none."""
    cut = (
        items.select("item_id", words_of(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))).alias("at"))
        .select("item_id", F.array_join(F.slice("w", F.col("at"), F.lit(width)), " ").alias("phrase"))
    )
    phrases = cut.select("phrase").distinct().withColumn("window_id", F.monotonically_increasing_id())
    phrases = stored(phrases.withColumn("terms", F.split("phrase", " ")).withColumn("n", F.size("terms")), "phrases")
    return phrases, stored(cut.distinct().join(phrases.select("phrase", "window_id"), "phrase").select("window_id", "item_id"), "owners")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the terms occurs in all texts; terms is a stored table, broadcast if it is small."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def probes_of(phrases: DataFrame, counts: DataFrame, probes: int = PROBES) -> DataFrame:
    """window_id, n, rank, term, offset: each window's rarest distinct terms with their first offset in it. Windows with a term that no document has cannot match and are left out."""
    spread = phrases.select("window_id", "n", F.posexplode("terms").alias("offset", "term"))
    spread = spread.groupBy("window_id", "n", "term").agg(F.min("offset").alias("offset"))
    known = spread.join(counts.withColumnRenamed("n", "freq"), "term", "left")
    by_window = Window.partitionBy("window_id")
    ranked = known.withColumn("missing", F.max(F.col("freq").isNull()).over(by_window)).withColumn(
        "rank", F.row_number().over(by_window.orderBy(F.col("freq"), F.col("term")))
    )
    return ranked.where(~F.col("missing") & (F.col("rank") <= probes)).select("window_id", "n", "rank", "term", "offset")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_key, pos (from 0) of the given terms in docs (doc_key, text); terms is a stored table, broadcast if it is small."""
    tokens = docs.select("doc_key", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return tokens.join(small(terms), "term").select("term", "doc_key", "pos")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with doc_key, which tells rows by doc_id and text; equal rows share a key and so a result."""
    return docs.select(F.xxhash64("doc_id", "text").alias("doc_key"), "doc_id", "text")


def candidates(index: DataFrame, probes: DataFrame) -> DataFrame:
    """doc_key, start, window_id, n where all probe terms stand at their offsets."""
    probes = probes.withColumnRenamed("n", "width")
    first = small(probes.where("rank = 1").drop("rank"))
    found = index.join(first, "term").select("doc_key", (F.col("pos") - F.col("offset")).alias("start"), "window_id", "width").where("start >= 0")
    # a document has as many starts of a window as of its rarest term; further lists only thin them out
    # each further list sets its own bit, so that equal rows, whose postings repeat, count once
    second = probes.where("rank > 1").select("window_id", F.col("term").alias("t2"), F.col("offset").alias("o2"), F.expr("shiftleft(1L, rank)").alias("bit"))
    thin = found.join(small(second), "window_id", "left")
    there = index.select(F.col("term").alias("t2"), "doc_key", F.col("pos").alias("p2"))
    ok = thin.where("t2 IS NOT NULL").withColumn("p2", F.col("start") + F.col("o2")).join(there, ["t2", "doc_key", "p2"], "left_semi")
    need = second.groupBy("window_id").agg(F.bit_or("bit").alias("need"))
    checked = ok.groupBy("doc_key", "start", "window_id", "width").agg(F.bit_or("bit").alias("got")).join(small(need), "window_id").where("got = need").drop("got", "need")
    return thin.where("t2 IS NULL").select(*checked.columns).unionByName(checked)


def phrase_matches(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """docs (text and others, but no words, doc_key, n_words, n_hit, windows) with n_words, n_hit (words within any
    exact occurrence of a phrase) and windows (sorted ids of the phrases that occur)."""
    keyed = docs.withColumn("doc_key", F.xxhash64(*docs.columns))
    terms = stored(phrases.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = stored(term_counts(docs, terms), "counts")
    probes = stored(probes_of(phrases, counts), "probes")
    index = stored(postings(keyed.select("doc_key", "text"), stored(probes.select("term").distinct(), "lookups")), "postings")
    found = candidates(index, probes).join(small(phrases.select("window_id", "phrase")), "window_id")
    found = found.groupBy("doc_key").agg(F.collect_set(F.struct("start", "width", "window_id", "phrase")).alias("cands"), F.sum(F.octet_length("phrase") + 64).alias("bytes"))
    found = stored(found, "candidates")
    most = found.agg(F.sum("bytes")).first()[0] or 0
    found = found.drop("bytes") if most > BROADCAST_BYTES else F.broadcast(found.drop("bytes"))
    # one pass over the documents: the words of each row confirm its own candidates, so that keys need not be unique
    rows = keyed.join(found, "doc_key", "left").withColumn("words", words_of(F.col("text")))
    exact = F.filter(F.coalesce("cands", F.array().cast(rows.schema["cands"].dataType)), lambda c: F.array_join(F.slice(F.col("words"), c.start + 1, c.width), " ") == c.phrase)
    rows = rows.withColumn("cands", exact).withColumn("n_words", F.size("words").cast("long"))
    places = F.array_sort(F.transform("cands", lambda c: F.struct(c.start.cast("long").alias("start"), (c.start + c.width).cast("long").alias("end"))))
    zero = F.lit(0).cast("long")
    n_hit = F.aggregate(
        places,
        F.struct(zero.alias("done"), zero.alias("n")),
        lambda acc, x: F.struct(F.greatest(acc.done, x.end).alias("done"), (acc.n + F.greatest(zero, x.end - F.greatest(x.start, acc.done))).alias("n")),
        lambda acc: acc.n,
    )
    ids = F.array_sort(F.array_distinct(F.transform("cands", lambda c: c.window_id)))
    return rows.select(*docs.columns, "n_words", n_hit.alias("n_hit"), ids.alias("windows"))


def near_matches(docs: DataFrame, term_sets: DataFrame, span: int) -> DataFrame:
    """set_id, doc_id, start, end of the places where all terms of a set (set_id, terms array of
    lower-case words) stand within `span` words: for each posting of a set's rarest term, the least
    stretch that holds it and every other term, if it is at most span words long."""
    own = keyed(docs)
    spread = term_sets.select("set_id", F.explode(F.array_distinct("terms")).alias("term"))
    spread = stored(spread, "sets")
    terms = stored(spread.select("term").distinct(), "terms")
    index = stored(postings(own, terms), "postings")
    counts = index.groupBy("term").agg(F.count("*").alias("freq"))
    ranked = spread.join(counts, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy("freq", "term"))).withColumn("size", F.count("*").over(Window.partitionBy("set_id")))
    anchors = index.join(ranked.where("rank = 1").select("set_id", "term", "size"), "term").select("set_id", "size", "doc_key", F.col("pos").alias("anchor"))
    others = index.join(ranked.where("rank > 1").select("set_id", "term"), "term").select("set_id", "doc_key", "term", "pos")
    # positions in blocks of span words: a term near an anchor is in the anchor's block or a neighbour
    blocks = anchors.withColumn("block", F.explode(F.array(*[(F.col("anchor") / span).cast("long") + d for d in (-1, 0, 1)])))
    near = blocks.join(others.withColumn("block", (F.col("pos") / span).cast("long")), ["set_id", "doc_key", "block"]).where(F.abs(F.col("pos") - F.col("anchor")) < span)
    places = near.groupBy("set_id", "size", "doc_key", "anchor", "term").agg(F.collect_set(F.col("pos").cast("long")).alias("pos"))
    whole = places.groupBy("set_id", "size", "doc_key", "anchor").agg(F.collect_list("pos").alias("pos")).where(F.size("pos") == F.col("size") - 1)
    anchor = F.col("anchor").cast("long")
    # a stretch starts at the anchor or a posting before it and goes to the last of every term's first posting from there
    starts = F.array_distinct(F.concat(F.array(anchor), F.filter(F.flatten("pos"), lambda s: s < anchor)))
    firsts = lambda s: F.transform("pos", lambda term: F.array_min(F.filter(term, lambda p: p >= s)))
    ends = F.transform(starts, lambda s: F.struct(s.alias("start"), firsts(s).alias("firsts")))
    fits = F.transform(F.filter(ends, lambda x: F.forall(x.firsts, lambda p: p.isNotNull())), lambda x: F.struct((F.greatest(anchor, F.array_max(x.firsts)) - x.start).alias("length"), x.start.alias("start")))
    whole = whole.select("set_id", "doc_key", F.array_min(fits).alias("best")).where("best IS NOT NULL")
    single = anchors.where("size = 1").select("set_id", "doc_key", F.col("anchor").alias("start"), F.col("anchor").alias("end"))
    found = whole.select("set_id", "doc_key", F.col("best.start").alias("start"), (F.col("best.start") + F.col("best.length")).alias("end")).unionByName(single).where(F.col("end") - F.col("start") < span)
    return found.join(own.select("doc_key", "doc_id").distinct(), "doc_key").select("set_id", "doc_id", "start", "end").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items of every row of docs (doc_id, text).

    A word inside any occurrence of a window is hit, once. items lists the item_ids with
    occurring windows, sorted as strings; an item with a null id is not listed. Null and
    empty texts have no words; equal rows get equal results, whatever their number, and
    every row is judged by its own words. Very long texts are one row like others."""
    phrases, owners = windows(items, width)
    rows = stored(phrase_matches(docs.select("doc_id", "text"), phrases).drop("text"), "rows")
    # the items are a function of the windows: each set of windows is looked up once
    sets = rows.where(F.size("windows") > 0).select("windows").distinct()
    named = sets.select("windows", F.explode("windows").alias("window_id")).join(small(owners), "window_id")
    named = named.select("windows", F.col("item_id").cast("string").alias("item")).where("item IS NOT NULL")
    named = named.groupBy("windows").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    met = rows.where(F.size("windows") > 0).join(named, "windows", "left").select("doc_id", "n_words", "n_hit", F.coalesce("items", none).alias("items"))
    return rows.where(F.size("windows") == 0).select("doc_id", "n_words", "n_hit", none.alias("items")).unionByName(met)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs without any hit, with their columns; each row is judged by its own words."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    phrases, _ = windows(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return phrase_matches(rows, phrases).where("n_hit = 0").select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, p)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM m) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
