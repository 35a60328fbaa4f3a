"""Embedding whitening by hierarchical SVD merging.

Every partition of the distinct vectors keeps its count, exact sums, mean, singular values and right vectors, all
dimensions of them. Two such summaries are merged by stacking both triangular factors (singular values times vectors)
and one row that corrects for the means, sqrt(n1 * n2 / (n1 + n2)) * (mean1 - mean2), and decomposing again: nothing is
lost but rounding. Summaries are merged eight at a time until one is left, so no task holds more than eight of them,
d * d doubles each, whatever the number of rows.

Defined results: a vector that is null or holds null, NaN or an infinity gives no row and does not count. Vectors
shorter than the longest count as padded with zeros. Equal vectors are one in the fit and each keep their rows, equal
rows and null ids too. A component whose eigenvalue is zero to double precision (fewer distinct vectors than
dimensions, constant dimensions) cannot be scaled and gives no row; so an empty table, one vector or equal vectors give
none. Components of equal eigenvalues are some orthonormal basis of their space, the same for every row; each is
turned so that its entry of largest size is positive. An entry whose 256-fold does not fit a long is cut to the
limits of a long; a deviation that does not fit is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Components that the query returns; the model keeps all.
COMPONENTS = 4
#: Summaries that one task merges, and vectors that it decomposes at once.
FAN_IN, BLOCK_ROWS = 8, 4096
SUMMARY = "n long, sums array<decimal(38,0)>, mean array<double>, factor binary"


@dataclass
class Summary:
    """Of some vectors: how many, exact sums, mean, and singular values times right vectors of the centred rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    factor: np.ndarray


def _factor(rows: np.ndarray) -> np.ndarray:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def summary_of(x: np.ndarray) -> Summary:
    """Of the rows of an integer matrix."""
    n, d = x.shape
    wide = n * int(max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0) >= 2**62
    sums = [sum(map(int, x[:, j])) for j in range(d)] if wide else [int(v) for v in x.sum(axis=0)]
    mean = np.array([s / n for s in sums])
    return Summary(n, sums, mean, _factor(x.astype(np.float64) - mean))


def merged(a: Summary, b: Summary) -> Summary:
    n = a.n + b.n
    sums = [p + q for p, q in zip(a.sums, b.sums)]
    shift = np.sqrt(a.n * b.n / n) * (a.mean - b.mean)
    return Summary(n, sums, np.array([s / n for s in sums]), _factor(np.vstack([a.factor, b.factor, shift[None, :]])))


def _row(s: Summary, **more) -> pa.RecordBatch:
    from decimal import Decimal

    columns = {
        "n": pa.array([s.n], pa.int64()), "sums": pa.array([[Decimal(v) for v in s.sums]], pa.list_(pa.decimal128(38, 0))),
        "mean": pa.array([s.mean.tolist()], pa.list_(pa.float64())), "factor": pa.array([s.factor.tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns | {k: pa.array([v], pa.int64()) for k, v in more.items()})


def _read(batch: pa.RecordBatch) -> Iterator[Summary]:
    for r in batch.select(["n", "sums", "mean", "factor"]).to_pylist():
        yield Summary(r["n"], [int(v) for v in r["sums"]], np.array(r["mean"]), np.frombuffer(r["factor"]).reshape(-1, len(r["mean"])))


def levels(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows count, their levels floor(256 * c) as a matrix of longs, padded to width)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    values = column.flatten()
    known = ~np.asarray(values.is_null()) if len(values) else np.zeros(0, bool)
    flat = np.asarray(values.cast(pa.float64()).fill_null(0.0), np.float64) if len(values) else np.zeros(0)
    known &= np.isfinite(flat)
    row = np.repeat(np.arange(len(column)), lengths)
    good = ~np.asarray(column.is_null())
    good[row[~known]] = False
    take = good[row]
    scaled = np.floor(np.where(known, flat, 0.0) * 256.0)
    out = np.zeros((len(column), width), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    low, high = scaled <= -(2.0**63), scaled >= 2.0**63
    whole = np.where(low | high, 0.0, scaled).astype(np.int64)
    whole[low], whole[high] = -(2**63), 2**63 - 1
    out[row[take], place[take]] = whole[take]
    return good, out[good]


def _packed(x: np.ndarray) -> list[bytes]:
    """Bytes of each row, of shorts where all its levels fit one, with a mark of which."""
    short = np.abs(np.clip(x, -(2**40), 2**40)).max(axis=1, initial=0) < 2**15
    narrow = x.astype(np.int16)
    return [b"s" + narrow[i].tobytes() if short[i] else b"l" + x[i].tobytes() for i in range(len(x))]


def _unpacked(keys: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(keys), width), np.int64)
    for i, k in enumerate(keys):
        out[i] = np.frombuffer(k, np.int16 if k[:1] == b"s" else np.int64, offset=1)
    return out


def distinct_levels(df: DataFrame, column: str, width: int) -> DataFrame:
    """x (binary): the levels of each distinct vector of df, once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = levels(batch.column(0), width)
            yield pa.RecordBatch.from_pydict({"x": pa.array(_packed(x), pa.binary())})

    return df.select(column).mapInArrow(pack, "x binary").distinct()


def summaries(distinct: DataFrame, width: int) -> DataFrame:
    """One summary for each partition that has rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = None, []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= BLOCK_ROWS:
                own = summary_of(_unpacked(held[:BLOCK_ROWS], width))
                total, held = merged(total, own) if total else own, held[BLOCK_ROWS:]
        if held:
            own = summary_of(_unpacked(held, width))
            total = merged(total, own) if total else own
        if total:
            yield _row(total)

    return distinct.mapInArrow(fold, SUMMARY)


def merge_all(parts: DataFrame) -> Summary | None:
    """The summary of all rows. parts: a stored table of summaries."""

    def fold(group: pa.Table) -> pa.Table:
        total = None
        for batch in group.to_batches():
            for own in _read(batch):
                total = merged(total, own) if total else own
        return pa.Table.from_batches([_row(total)])

    count = parts.count()
    while count > FAN_IN:
        groups = -(-count // FAN_IN)
        # a plain number dealt by content, so that a task that runs again meets the same groups
        numbered = parts.withColumn("at", F.pmod(F.xxhash64("factor", "mean"), F.lit(groups)))
        parts = stored(numbered.groupBy("at").applyInArrow(fold, SUMMARY), "summaries")
        count = parts.count()
    total = None
    for batch in parts.toArrow().to_batches():  # at most FAN_IN summaries, d * d doubles each
        for own in _read(batch):
            total = merged(total, own) if total else own
    return total


@dataclass
class Whitening:
    """A fitted model: width, n, exact sums, eigenvalues of the covariance (falling, positive ones) and unit components as rows."""

    width: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray


def model_of(total: Summary | None, width: int) -> Whitening:
    if total is None:
        return Whitening(width, 0, [0] * width, 0.0, np.zeros(0), np.zeros((0, width)))
    _, s, v = np.linalg.svd(total.factor, full_matrices=False)
    keep = s > (s[0] if len(s) else 0.0) * max(total.n, width) ** 0.5 * 1e-14 if len(s) else np.zeros(0, bool)
    s, v = s[keep], v[keep]
    if len(v):
        v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return Whitening(width, total.n, total.sums, float((s**2).sum() / total.n), s**2 / total.n, v)


def fit(df: DataFrame, column: str) -> tuple[Whitening, DataFrame]:
    """(model, the distinct vectors it was fitted on, stored)."""
    width = df.select(F.max(F.size(F.coalesce(column, F.array())))).first()[0] or 0
    width = max(0, width)
    distinct = stored(distinct_levels(df, column, width), "distinct")
    return model_of(merge_all(stored(summaries(distinct, width), "summaries")) if width else None, width), distinct


def projected(x: np.ndarray, model: Whitening, dims: int) -> np.ndarray:
    """The whitened rows of x on the first dims components."""
    if model.n * int(np.abs(x.astype(np.float64)).max(initial=0.0) + 1) < 2**62:
        centred = (model.n * x - np.array(model.sums, np.int64)) / model.n
    else:
        centred = x.astype(np.float64) - np.array([s / model.n for s in model.sums])
    return centred @ model.components[:dims].T / np.sqrt(model.values[:dims])


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exact; None where it does not fit a long."""
    most = model.n * (float(np.abs(x.astype(np.float64)).max(initial=0.0)) + 1) + float(max((abs(s) for s in model.sums), default=0))
    if most * most * max(1, model.width) < 2**62:
        gap = model.n * x - np.array(model.sums, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    exact = [sum((model.n * int(c) - s) ** 2 for c, s in zip(row, model.sums)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def whiten(df: DataFrame, model: Whitening, column: str, dims: int | None = None) -> DataFrame:
    """Rows of df that count, with whitened (array<double>, the first dims components, else all) and deviation in a struct `_white`."""
    dims = len(model.values) if dims is None else min(dims, len(model.values))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = levels(batch.column(0), model.width)
            rows = batch.column(1).filter(pa.array(good))
            white = projected(x, model, dims).tolist() if len(x) else []
            yield pa.RecordBatch.from_arrays([rows, pa.array(white, pa.list_(pa.float64())), pa.array(deviations(x, model), pa.int64())], ["row", "whitened", "deviation"])

    packed = df.select(F.col(column).alias("v"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != column]).alias("row"))
    kind = packed.schema["row"].dataType
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    return packed.mapInArrow(apply, StructType([StructField("row", kind), StructField("whitened", ArrayType(DoubleType())), StructField("deviation", LongType())]))


def identity_error(distinct: DataFrame, model: Whitening, dims: int) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpacked(batch.column(0).to_pylist(), model.width)
            yield pa.RecordBatch.from_pydict({f"w{k}": pa.array(w) for k, w in enumerate(projected(x, model, dims).T)})

    white = distinct.mapInArrow(apply, ", ".join(f"w{k} double" for k in range(dims)))
    found = white.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in range(dims) for j in range(i, dims)]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(dims) for j in range(i, dims))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model, distinct = fit(rows, "embedding")
    dims = min(COMPONENTS, len(model.values))
    error = identity_error(distinct, model, dims) if dims else 0.0
    white = whiten(rows, model, "embedding", dims)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values[:dims]]) if dims else F.lit(None).cast("array<double>")
    out = white.select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
