"""Resumable labelling: files in, one folder per micro-batch out.

The checkpoint takes the place of a processed-id file: a restart goes on after
the last committed batch, and a batch that is run again overwrites its folder.
Failures and progress are kept in the shared store, so that they outlive the driver.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from shelfwise.fixed_values import MAX_CONSECUTIVE_FAILURES
from shelfwise.sources import files

PROGRESS = "batch_id bigint, n_rows bigint, rows_per_second double, run_id string, at string"


class TooManyFailures(Exception):
    """A batch has failed as often in a row as is allowed."""


class Failures:
    """Failed attempts of batches, a small file each, beside the checkpoint.

    A stream repeats a batch until it is committed, so the attempts of one batch are
    failures in a row, whichever driver made them.
    """

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.path = spark, f"{checkpoint.rstrip('/')}-failures"

    def count(self, batch_id: int) -> int:
        return len(files.names(self.spark, f"{self.path}/{batch_id}"))

    def add(self, batch_id: int, reason: str) -> None:
        files.write_new(self.spark, f"{self.path}/{batch_id}/{uuid.uuid4().hex}.json", json.dumps({"reason": reason}))

    def clear(self, batch_id: int) -> None:
        """Forget a batch, so that a stopped stream may try it again."""
        files.remove(self.spark, f"{self.path}/{batch_id}")


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream; new files are new rows."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_labelling(
    stream: DataFrame,
    label: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    max_failures: int = MAX_CONSECUTIVE_FAILURES,
) -> StreamingQuery:
    """Label all that is available, batch by batch, and stop.

    Rows with a non-null ``error`` column, if the labelled frame has one, go to a
    folder of their own: they are neither dropped nor counted as labelled. A batch that
    has failed ``max_failures`` times, under this driver or an earlier one, is not tried
    again: the query ends with ``TooManyFailures``.
    """
    failures = Failures(stream.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        if failures.count(batch_id) >= max_failures:
            raise TooManyFailures(f"batch {batch_id} failed {max_failures} times in a row")
        try:
            save(batch, batch_id)
        except Exception as e:
            failures.add(batch_id, f"{type(e).__name__}: {str(e)[:500]}")
            raise

    def save(batch: DataFrame, batch_id: int) -> None:
        labelled = label(batch)
        if "error" not in labelled.columns:
            labelled.write.mode("overwrite").parquet(f"{out}/labelled/batch_id={batch_id}")
            return
        labelled = labelled.persist()
        good = labelled.where("error is null").drop("error")
        good.write.mode("overwrite").parquet(f"{out}/labelled/batch_id={batch_id}")
        bad = labelled.where("error is not null")
        bad.write.mode("overwrite").parquet(f"{out}/errors/batch_id={batch_id}")
        labelled.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain(start: Callable[[], StreamingQuery], max_failures: int = MAX_CONSECUTIVE_FAILURES) -> int:
    """Run a query to its end, restarting it after a failure; returns the restarts.

    Stops with the error once ``max_failures`` runs in a row failed without a
    batch committed in between, or the query says so itself, which also counts the runs
    of earlier drivers. Single tasks are retried by Spark itself.
    """
    restarts = failures = 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return restarts
        except StreamingQueryException as e:
            # the failed batch reports no progress, a committed one does
            failures = 1 if query.recentProgress else failures + 1
            if failures >= max_failures or TooManyFailures.__name__ in str(e):
                raise
            restarts += 1


class ProgressLog(StreamingQueryListener):
    """Writes the progress of each batch of the session's queries to a folder, a small file each.

    Use as a context around the runs to record; it waits at its end until the queries that
    were started inside have reported all. A batch that is run again has a file per run.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.open, self.changed = set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"batch_id": p.batchId, "n_rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "run_id": str(p.runId), "at": p.timestamp}
        try:
            files.write_new(self.spark, f"{self.folder}/{p.runId}-{p.batchId}.json", json.dumps(row))
        except FileExistsError:  # an idle trigger reports the batch before once more
            pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.open.discard(str(event.runId))
            self.changed.notify_all()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        with self.changed:  # events come in order: progress before the end of a query
            self.changed.wait_for(lambda: not self.open, timeout=60)
        self.spark.streams.removeListener(self)


def logged_progress(spark: SparkSession, folder: str) -> DataFrame:
    """``(batch_id, n_rows, rows_per_second, run_id, at)`` of all runs so far, each batch once: its last run."""
    kept = spark.read.schema(PROGRESS).json(folder)
    last = kept.groupBy("batch_id").agg(F.max("at").alias("at"))
    return kept.join(last, ["batch_id", "at"], "left_semi")


def labelled_rows(spark: SparkSession, out: str) -> DataFrame:
    """All labelled rows so far, with their ``batch_id``."""
    return spark.read.parquet(f"{out}/labelled")


def batch_counts(spark: SparkSession, out: str) -> DataFrame:
    """Rows per committed batch."""
    return labelled_rows(spark, out).groupBy(F.col("batch_id").cast("long").alias("batch_id")).agg(
        F.count("*").alias("n_rows")
    )


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """``(batch_id, n_rows, rows_per_second)`` of the query's recent batches."""
    rows = [(p.batchId, p.numInputRows, p.processedRowsPerSecond) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch_id bigint, n_rows bigint, rows_per_second double")
