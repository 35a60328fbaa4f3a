"""Secret scans: a ledger of scanned blobs.

A text is addressed by its SHA-256. The ledger, a folder, says which (blob, rule
version) pairs have been scanned; a run scans only pairs that it lacks, whatever
number of documents, paths or earlier versions hold the same blob. Findings are kept
by blob and rule version and joined back to every document, or to every path and
version of a history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, work_dir

#: A private key from its BEGIN line through the next END line or, if there is none before another begins or the
#: text ends, through the headers and base64 lines that follow. Line breaks may be written as \\n. Possessive, so that
#: long texts take no stack.
_BREAKS = r"(?:[ \t>\r\n]|\\[rn])*+"
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_BREAKS}(?:(?:Proc-Type|DEK-Info|Key-Info|Content-Domain|Comment|Version):[^\r\n\\]*+|[A-Za-z0-9+/]{{16,}}+={{0,2}}))++"
    r"(?:[ \t]*+(?:\r?\n|\\r\\n|\\n)[ \t>]*+[A-Za-z0-9+/]{1,15}+={0,2}(?![^\s\\\"',]))?+"
    rf"|{_BREAKS}[A-Za-z0-9+/]{{1,15}}+={{0,2}}\s*+(?![\s\S]))?+"
)
#: kind: (version, pattern, group whose length counts, least length, literal gate).
#: The first three are the base kinds, in the order in which ties are listed.
RULES = {
    "assign": (1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"(?i)password|passwd|secret|token|api_?key"),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    "hex": (1, r"[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
    "github": (1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh[pousr]_"),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, "eyJ"),
    # through the END line of the same kind; without one, through the header and base64 lines that follow
    "pem": (2, PEM, 0, 27, "-----BEGIN"),
}
BASE = ["assign", "access", "hex"]
LEDGER = "blob string, checked array<string>, found array<struct<start:long,kind:int,name:string,end:long>>"


def rule_key(name: str) -> str:
    return f"{name}@{RULES[name][0]}"


#: Elements that are folded at once by `running`, and code points of a piece that `redacted` cuts from.
FOLDED, PIECE = 64, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For an array of longs, one value more: fold over all elements before each place, from 0, and over all.

    Blocks are folded first, so that no long array is copied once for each of its elements."""
    start = lambda at: F.struct(at.alias("at"), F.array(at).alias("out"))

    def prefixes(array: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            new = fold(acc.at, x)
            return F.struct(new.alias("at"), F.concat(acc.out, F.array(new)).alias("out"))

        return F.aggregate(array, start(at), step, lambda acc: acc.out)

    def whole(array: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / FOLDED).cast("int")), lambda b: F.slice(array, b * FOLDED + 1, FOLDED))
        zero = F.lit(0).cast("long")

        def joined(blocks: Column) -> Column:
            heads = prefixes(F.transform(blocks, lambda x: F.aggregate(x, zero, lambda at, y: fold(at, y))), zero)
            inner = F.zip_with(blocks, F.slice(heads, 1, F.size(blocks)), lambda x, at: F.slice(prefixes(x, at), 1, F.size(x)))
            return F.concat(F.flatten(inner), F.slice(heads, -1, 1))

        return F.when(F.size(array) == 0, F.array(zero)).otherwise(_let(blocks, joined))

    return _let(values, whole)


def spans(text: Column, name: str, order: int) -> Column:
    """array<struct<start, kind, name, end>> of one rule's matches in code points.

    The pieces between the matches and the matches themselves, both in order,
    give every offset."""
    _, pattern, group, least, _ = RULES[name]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    pairs = F.zip_with(found, counted, lambda m, c: F.struct(F.length(m).cast("long").alias("len"), (F.length(c) >= least).alias("ok")))
    rows = F.transform(F.filter(F.arrays_zip(between.alias("gap"), pairs.alias("m")), lambda x: x.m.isNotNull()), lambda x: F.struct(x.gap.alias("gap"), x.m.len.alias("len"), x.m.ok.alias("ok")))

    def placed(rows: Column) -> Column:
        ends = F.slice(running(F.transform(rows, lambda x: x.gap + x.len), lambda at, x: at + x), 2, F.size(rows))
        whole = F.zip_with(rows, ends, lambda x, end: F.struct((end - x.len).alias("start"), F.lit(order).alias("kind"), F.lit(name).alias("name"), end.alias("end"), x.ok.alias("ok")))
        return F.transform(F.filter(whole, lambda x: x.ok), lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x["name"].alias("name"), x.end.alias("end")))

    return _let(rows, placed)


def redacted(text: Column, found: Column, mask: str) -> Column:
    """text with the spans (sorted by start) replaced by the mask, overlapping ones by one. Text is cut from pieces of bounded size."""

    def cut(chunks: Column) -> Callable[[Column], Column]:
        chunk = lambda k: F.coalesce(F.try_element_at(chunks, (k + 1).cast("int")), F.lit(""))

        def part(x: Column) -> Column:
            a, b = F.floor(x.lo / PIECE), F.floor(x.hi / PIECE)
            at = lambda p: (p % PIECE).cast("int")
            inside = F.substring(chunk(a), at(x.lo) + 1, (x.hi - x.lo).cast("int"))
            over = F.concat(F.substring(chunk(a), at(x.lo) + 1, F.lit(PIECE)), F.array_join(F.slice(chunks, (a + 2).cast("int"), F.greatest(F.lit(0), b - a - 1).cast("int")), ""), F.substring(chunk(b), F.lit(1), at(x.hi)))
            return F.when(a == b, inside).otherwise(over)

        return part

    def whole(done: Column) -> Column:
        """done: before each span, and after all, the end of what the spans so far cover"""
        marked = F.zip_with(found, F.slice(done, 1, F.size(found)), lambda x, d: F.struct(d.alias("lo"), x.start.alias("hi")))
        gaps = F.concat(F.filter(marked, lambda x: x.hi >= x.lo), F.array(F.struct(F.element_at(done, -1).alias("lo"), F.length(text).cast("long").alias("hi"))))
        return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda chunks: F.array_join(F.transform(gaps, cut(chunks)), mask))

    return _let(running(F.transform(found, lambda x: x.end), F.greatest), whole)


def ledger_scan(docs: DataFrame, ledger: DataFrame | None = None, rules: list[str] | None = None) -> DataFrame:
    """The new ledger rows (blob, checked, found) for the texts of docs (text; other columns are ignored).

    `checked` lists the rule versions that this run scanned the blob for, `found`
    their spans. Null is the empty text. Only blobs with unseen pairs are scanned,
    each once; only texts in which an unseen rule's literal occurs are moved."""
    names = list(RULES) if rules is None else rules
    keys = F.array(*[F.lit(rule_key(n)) for n in names])
    text = F.coalesce("text", F.lit(""))
    gate = "|".join(RULES[n][4] for n in names)
    seen = docs.select(F.sha2(text, 256).alias("blob"), F.when(text.rlike(gate), text).alias("text"))
    # the rows of a blob have the same text, so any of them may stand for it
    blobs = seen.dropDuplicates(["blob"])
    if ledger is not None:
        known = ledger.select("blob", F.explode("checked").alias("key")).groupBy("blob").agg(F.collect_set("key").alias("known"))
        blobs = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("known", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", keys)
    none = F.array().cast("array<struct<start:long,kind:int,name:string,end:long>>")
    parts = []
    for order, name in enumerate(RULES):
        if name in names:
            wanted = F.array_contains("todo", rule_key(name)) & F.col("text").rlike(RULES[name][4])
            parts.append(F.when(wanted, spans(F.col("text"), name, order)).otherwise(none))
    return blobs.select("blob", F.col("todo").alias("checked"), F.array_sort(F.concat(*parts)).alias("found"))


class BlobLedger:
    """A ledger in a folder, new or from earlier runs: `scan` adds what is unseen, `findings` is every blob's spans.

    Each scan appends one set of files; a scan that fails leaves nothing behind that is
    read, and can be run again. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.alone = spark, path, False

    def rows(self) -> DataFrame | None:
        """blob, checked, found of all runs; None before the first."""
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def scan(self, docs: DataFrame, rules: list[str] | None = None) -> None:
        known = self.rows()
        ledger_scan(docs, known, rules).write.mode("append").option("compression", "zstd").parquet(self.path)
        self.alone = known is None

    def findings(self) -> DataFrame:
        """blob, found: one row for each blob with findings by the rules' present versions."""
        present = F.array(*[F.lit(rule_key(n)) for n in RULES])
        now = F.array_intersect("checked", present)
        rows = self.rows().select("blob", F.filter("found", lambda x: F.exists(now, lambda k: k.startswith(F.concat(x["name"], F.lit("@"))))).alias("found")).where(F.size("found") > 0)
        if self.alone:  # a blob has one row a run
            return rows
        return rows.select("blob", F.explode("found").alias("x")).groupBy("blob").agg(F.array_sort(F.collect_set("x")).alias("found"))


def join_back(docs: DataFrame, findings: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (the keys and text) -> the keys, found (sorted spans, empty if none), one row for each row of docs.

    The rows may be documents, or the paths and versions of a history."""
    none = F.array().cast("array<struct<start:long,kind:int,name:string,end:long>>")
    paths = docs.select(*keys, F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    return paths.join(findings, "blob", "left").select(*keys, F.coalesce("found", none).alias("found"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["name"], x.start.cast("string"), x.end.cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = BlobLedger(spark, f"{work_dir(spark)}/ledger")
    ledger.scan(docs)
    found = join_back(docs, ledger.findings())
    count = lambda k: F.size(F.filter("found", lambda x: x.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(_listed(F.filter("found", lambda x: x.kind < len(BASE))), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span of text replaced by the mask (overlapping spans by one); all rows and columns stay."""
    ledger = BlobLedger(spark, f"{work_dir(spark)}/ledger")
    ledger.scan(docs)
    # the document's own columns stay in one struct, whatever their names
    packed = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = packed.join(ledger.findings(), "blob", "left")
    text = F.when(F.col("found").isNull() | F.col("row.text").isNull(), F.col("row.text")).otherwise(redacted(F.col("row.text"), F.col("found"), mask))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")
