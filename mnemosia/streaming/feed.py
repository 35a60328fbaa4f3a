"""Change feed: an append-only table of changes, read as a stream or replayed.

Changes have change_id, tenant, type, ts, payload. A tenant's changes are numbered from 1 as
they arrive, those of one batch in the order of (ts, change_id). The last 1000 changes of a
tenant, none more than an hour older than its newest, can be replayed.

As a stream, the numbers and the replay buffer are state: a batch costs its own rows and what
they push out, never the history, and a restart goes on where the checkpoint ends. As a table,
`sequenced` numbers hours apart and adds up what came before, so a tenant's rows are dealt over
as many tasks as it has hours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUFFER, MAX_AGE_S, MAX_PAYLOAD = 1000, 3600, 4096
#: Held changes that are one value of the state.
BLOCK = 64
EPOCH = datetime(1970, 1, 1)
SCHEMA = "change_id long, tenant string, type string, ts timestamp_ntz, payload string"
NUMBERED = "tenant string, seq long, change_id long, type string, ts timestamp_ntz, payload string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def valid(changes: DataFrame) -> DataFrame:
    """Rows with a tenant and a payload of at most 4 KB; a missing type is kg.change."""
    return changes.where(F.col("tenant").isNotNull() & (F.coalesce(F.octet_length("payload"), F.lit(0)) <= MAX_PAYLOAD)).withColumn("type", F.coalesce("type", F.lit("kg.change")))


def sequenced(changes: DataFrame) -> DataFrame:
    """changes with seq from 1 within each tenant, in the order of (ts, change_id)."""
    rows = valid(changes).withColumn("_hour", F.date_trunc("hour", "ts"))
    before = Window.partitionBy("tenant").orderBy(F.asc_nulls_first("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy("tenant", "_hour").agg(F.count("*").alias("n")).select("tenant", "_hour", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("tenant", "_hour").orderBy("ts", "change_id"))
    met = rows.withColumn("_place", place).alias("r").join(hours.alias("h"), [F.col("r.tenant") == F.col("h.tenant"), F.col("r._hour").eqNullSafe(F.col("h._hour"))])
    return met.select(*[F.col(f"r.`{c}`") for c in rows.columns if c != "_hour"], (F.col("h._before") + F.col("r._place")).alias("seq"))


def buffered(changes: DataFrame, as_of, size: int = BUFFER, max_age_s: int = MAX_AGE_S) -> DataFrame:
    """What may still be replayed at a time: the last `size` changes of each tenant, none older than max_age_s.

    Older rows are only counted; fresh ones alone are numbered and sorted."""
    rows = valid(changes)
    fresh = F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"make_dt_interval(0, 0, 0, {max_age_s})")
    counts = rows.groupBy("tenant").agg(F.count("*").alias("_last"), F.count_if(~fresh | F.col("ts").isNull()).alias("_old"))
    new = sequenced(rows.where(fresh)).join(counts, "tenant").withColumn("seq", F.col("seq") + F.col("_old"))
    return new.where(F.col("seq") > F.col("_last") - size).drop("_last", "_old")


def replay(buffer: DataFrame, tenant: str, since: int) -> tuple[DataFrame, bool]:
    """(changes after `since`, whether the reader must start anew because its last change is no longer held)."""
    own = buffer.where(F.col("tenant") == tenant)
    oldest = own.agg(F.min("seq")).first()[0]
    return own.where(F.col("seq") > since).orderBy("seq"), bool(since > 0 and oldest is not None and since < oldest)


class Numbering(StatefulProcessor):
    """By tenant: the last number given, the oldest one held, and the held changes in blocks, by a block's first number.

    A held change leaves when `size` later ones have come or the tenant's newest change is max_age_s later; with
    `expire` also max_age_s after it arrived, by the state's own time to live, so that silent tenants hold nothing.
    Each call on the state is a message to the JVM, so what a batch brings is put there in blocks of BLOCK rows. A block
    is never written again: until all of it has left, `oldest` says what has."""

    def __init__(self, size: int = BUFFER, max_age_s: int = MAX_AGE_S, expire: bool = False):
        self.size, self.max_age_s, self.expire = size, max_age_s, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, oldest long, newest timestamp_ntz, first long")
        self.held = handle.getMapState("held", "first long", "change_id array<long>, type array<string>, micros array<long>, payload array<string>", ttlDurationMs=self.max_age_s * 1000 if self.expire else None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        none = datetime.min
        seq, oldest, newest, first = self.last.get() if self.last.exists() else (0, 1, None, 1)
        new = sorted(rows, key=lambda r: (r.ts or none, -1 if r.change_id is None else r.change_id))
        newest = max([newest or none, *(r.ts or none for r in new)])
        cutoff = newest - timedelta(seconds=self.max_age_s) if newest > none else none
        least = seq + len(new) - self.size  # what has this number or less is pushed out by number
        if first <= seq <= least:
            self.held.clear()
            first = oldest = seq + 1
        # numbers are in the order of time within a batch, so what is too old leaves from the front
        while first <= seq:
            block = self.held.getValue((first,)) if self.held.containsKey((first,)) else None
            if block is None:  # its time to live has passed
                first += 1
                oldest = max(oldest, first)
                continue
            times = [none if t is None else EPOCH + timedelta(microseconds=t) for t in block[2]]
            while oldest < first + len(times) and (oldest <= least or times[oldest - first] < cutoff):
                oldest += 1
            if oldest < first + len(times):
                break
            self.held.removeKey((first,))
            first += len(times)
        empty, keep = first > seq, []
        for r in new:
            seq += 1
            if oldest == seq and (seq <= least or (r.ts or none) < cutoff):
                oldest += 1
            else:
                keep.append(r)
            yield Row(tenant=key[0], seq=seq, change_id=r.change_id, type=r.type, ts=r.ts, payload=r.payload)
        start = seq - len(keep) + 1
        for at in range(0, len(keep), BLOCK):
            own = keep[at : at + BLOCK]
            micros = [None if r.ts is None else (r.ts - EPOCH) // timedelta(microseconds=1) for r in own]
            self.held.updateValue((start + at,), ([r.change_id for r in own], [r.type for r in own], micros, [r.payload for r in own]))
        self.last.update((seq, oldest, newest, start if empty else first))

    def close(self) -> None:
        pass


def publish(changes: DataFrame, path: str) -> None:
    valid(changes).write.mode("append").parquet(path)


def subscribe(spark: SparkSession, path: str, checkpoint: str, deliver: Callable[[DataFrame, int], None], tenant: str | None = None, once: bool = False):
    """Starts a streaming query that hands each batch of new changes to deliver(frame, batch_id)."""
    rows = valid(spark.readStream.schema(SCHEMA).parquet(path))
    rows = rows.where(F.col("tenant") == tenant) if tenant else rows
    writer = rows.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def numbered(changes: DataFrame, size: int = BUFFER, max_age_s: int = MAX_AGE_S, expire: bool = False) -> DataFrame:
    """A stream of changes with their numbers (NUMBERED). Needs the RocksDB state store.

    A batch's rows of one tenant are sorted in one task: bound a batch by the source's maxFilesPerTrigger. `expire` is
    for streams that run on: with it a trigger of what is available now never ends, as time itself is then news."""
    mode = "ProcessingTime" if expire else "None"
    return valid(changes).groupBy("tenant").transformWithState(statefulProcessor=Numbering(size, max_age_s, expire), outputStructType=NUMBERED, outputMode="Append", timeMode=mode)


def run_numbering(spark: SparkSession, path: str, checkpoint: str, sink: str, size: int = BUFFER, max_age_s: int = MAX_AGE_S, files: int = 100) -> None:
    """Numbers what was published at path since the last run with this checkpoint and appends it to sink, then ends."""
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        rows = numbered(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path), size, max_age_s)
        rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The replay buffer (NUMBERED) as the last batch left it in the state: at most `size` rows of each tenant, whatever the history."""
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    rows = state("held")
    value = "user_map_value.value" if "value" in rows.schema["user_map_value"].dataType.names else "user_map_value"
    blocks = rows.select(F.col("key.tenant").alias("tenant"), F.col("user_map_key.first").alias("first"), F.posexplode(F.arrays_zip(*[F.col(f"{value}.{c}").alias(c) for c in ("change_id", "type", "micros", "payload")])).alias("at", "c"))
    oldest = state("last").select(F.col("key.tenant").alias("tenant"), F.col("value.oldest").alias("oldest"))
    ts = F.expr("timestamp_ntz'1970-01-01 00:00:00' + c.micros * INTERVAL '0.000001' SECOND").alias("ts")
    met = blocks.join(oldest, "tenant").where(F.col("first") + F.col("at") >= F.col("oldest"))
    return met.select("tenant", (F.col("first") + F.col("at")).alias("seq"), "c.change_id", "c.type", ts, "c.payload")


def windowed_counts(changes: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """tenant, type, window start and n, for streams (with a watermark) and tables alike."""
    stream = changes.withWatermark("ts", late) if changes.isStreaming else changes
    return stream.groupBy(F.window("ts", width).alias("w"), "tenant", "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "tenant", "type", "n")
