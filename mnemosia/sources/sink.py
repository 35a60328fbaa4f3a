"""A sink that calls an outside function for every row, and a ledger of what came of it.

Each batch of rows (id, text) becomes one part of the ledger: id, text, result, error, tries. A batch that runs again
after a lost driver replaces its own part. Rows whose last entry failed are the dead letters; the next batch takes them
up until they have had MOST_RUNS runs. The function gets lists of texts; where a list fails after its attempts,
each text is tried alone, so one bad text costs no other its result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attempts of a call, seconds before the second (doubled for each further one), calls in a row that fail before a task calls no more, runs of a row.
ATTEMPTS, FIRST_DELAY_S, BREAKER, MOST_RUNS = 3, 0.5, 5, 5
LEDGER = "id string, text string, result array<float>, error string, tries int"


def called(rows: DataFrame, function: Callable[[list[str]], list[list[float]]], attempts: int = ATTEMPTS, delay_s: float = FIRST_DELAY_S, breaker: int = BREAKER) -> DataFrame:
    """LEDGER rows of rows (id, text): the function's result, or the last error of any kind."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad = 0  # texts in a row that failed alone

        def call(texts: list[str]) -> tuple[list | None, str | None, int]:
            error = None
            for k in range(attempts):
                if k:
                    time.sleep(delay_s * 2 ** (k - 1))
                try:
                    found = function(texts)
                    if len(found) != len(texts):
                        raise ValueError(f"{len(found)} results for {len(texts)} texts")
                    return found, None, k + 1
                except Exception as e:  # noqa: BLE001 (whatever the function raises is the row's error)
                    error = f"{type(e).__name__}: {e}"
            return None, error, attempts

        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            found, _, tries = call(texts) if bad < breaker and texts else (None, None, 0)
            if found is not None:
                bad = 0
                yield pd.DataFrame({"id": frame["id"], "text": frame["text"], "result": found, "error": None, "tries": tries})
                continue
            out = []
            for t in texts:
                if bad >= breaker:
                    out.append((None, "not called: too many calls failed before", 0))
                    continue
                own, error, n = call([t])
                bad = 0 if own is not None else bad + 1
                out.append((own[0] if own is not None else None, error, tries + n))
            yield pd.DataFrame({"id": frame["id"], "text": frame["text"], "result": [o[0] for o in out], "error": [o[1] for o in out], "tries": [o[2] for o in out]})

    return rows.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, LEDGER)


class Ledger:
    """The ledger at a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self, before: int | None = None) -> DataFrame:
        """All entries with their batch; those of batches before a number, if it is given."""
        from pyspark.errors import AnalysisException

        try:
            found = self.spark.read.schema(f"{LEDGER}, batch long").parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = self.spark.createDataFrame([], f"{LEDGER}, batch long")
        return found if before is None else found.where(F.col("batch") < before)

    def latest(self, before: int | None = None) -> DataFrame:
        """id, text, result, error of each id's last entry, tries (over all) and runs."""
        last = F.max_by(F.struct("text", "result", "error"), "batch").alias("l")
        return self.rows(before).groupBy("id").agg(last, F.sum("tries").alias("tries"), F.count("*").alias("runs")).select("id", "l.*", "tries", "runs")

    def results(self) -> DataFrame:
        return self.latest().where("error IS NULL").select("id", "result")

    def dead_letters(self, before: int | None = None, most_runs: int | None = None) -> DataFrame:
        """The rows whose last entry failed; only those with fewer runs than most_runs, if it is given."""
        failed = self.latest(before).where("error IS NOT NULL")
        return failed if most_runs is None else failed.where(F.col("runs") < most_runs)

    def write(self, rows: DataFrame, batch: int, function: Callable, most_runs: int = MOST_RUNS, **settings) -> None:
        """One batch: new rows (id, text), and dead letters of earlier batches that have no new text."""
        new = rows.select(F.col("id").cast("string").alias("id"), "text")
        again = self.dead_letters(batch, most_runs).select("id", "text").join(new.select("id"), "id", "left_anti")
        called(new.unionByName(again), function, **settings).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def start(self, stream: DataFrame, checkpoint: str, function: Callable, once: bool = False, **settings):
        """A streaming query that writes each micro-batch of stream (id, text)."""
        writer = stream.writeStream.foreachBatch(lambda rows, n: self.write(rows, n, function, **settings)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
