"""A stream restarted midway equals one batch run."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import values
from shelfwise.streaming import labelling


@pytest.fixture
def source(spark, tmp_path):
    items = spark.range(40).withColumn("text", F.concat(F.lit("item "), "id"))
    path = str(tmp_path / "in")
    items.repartition(4).write.parquet(path)
    return path, items


def label(batch):
    return batch.withColumn("label", F.upper("text"))


def test_restart_gives_the_batch_result(spark, source, tmp_path):
    path, items = source
    out, checkpoint, calls = str(tmp_path / "out"), str(tmp_path / "checkpoint"), []

    def flaky(batch):
        calls.append(1)
        if len(calls) in (2, 3):
            raise RuntimeError("worker lost")
        return label(batch)

    def start():
        stream = labelling.file_stream(spark, path, items.schema, files_per_batch=1)
        return labelling.start_labelling(stream, flaky, out, checkpoint)

    assert labelling.drain(start) == 2
    assert values(labelling.labelled_rows(spark, out), "id", "text", "label") == values(label(items))
    assert sum(r.n_rows for r in labelling.batch_counts(spark, out).collect()) == 40

    spark.range(100, 105).withColumn("text", F.lit("new")).coalesce(1).write.mode("append").parquet(path)
    query = start()
    query.awaitTermination()
    assert labelling.progress(spark, query).agg(F.sum("n_rows")).first()[0] == 5
    assert labelling.labelled_rows(spark, out).count() == 45


def test_gives_up_after_three_failures(spark, source, tmp_path):
    path, items = source
    calls = []

    def broken(batch):
        calls.append(1)
        raise RuntimeError("always")

    def start():
        stream = labelling.file_stream(spark, path, items.schema)
        return labelling.start_labelling(stream, broken, str(tmp_path / "out"), str(tmp_path / "ck"))

    with pytest.raises(StreamingQueryException):
        labelling.drain(start)
    assert len(calls) == 3


def test_the_third_failure_stops_whichever_driver_it_was(spark, source, tmp_path):
    """A driver that is started anew after each failure, as its memory is lost, still stops."""
    path, items = source
    calls, checkpoint = [], str(tmp_path / "ck")

    def broken(batch):
        calls.append(1)
        if len(calls) > 1:
            raise RuntimeError("down")
        return label(batch)

    def driver():
        stream = labelling.file_stream(spark, path, items.schema, files_per_batch=1)
        query = labelling.start_labelling(stream, broken, str(tmp_path / "out"), checkpoint)
        with pytest.raises(StreamingQueryException) as e:
            query.awaitTermination()
        return str(e.value)

    messages = [driver() for _ in range(5)]
    assert len(calls) == 4  # one good batch, then three failures of the next
    assert ["TooManyFailures" in m for m in messages] == [False] * 3 + [True] * 2
    assert labelling.Failures(spark, checkpoint).count(1) == 3
    with pytest.raises(StreamingQueryException):
        labelling.drain(lambda: labelling.start_labelling(
            labelling.file_stream(spark, path, items.schema, files_per_batch=1), label, str(tmp_path / "out"), checkpoint))
    labelling.Failures(spark, checkpoint).clear(1)  # someone has looked at it
    stream = labelling.file_stream(spark, path, items.schema, files_per_batch=1)
    labelling.start_labelling(stream, label, str(tmp_path / "out"), checkpoint).awaitTermination()
    assert labelling.labelled_rows(spark, str(tmp_path / "out")).count() == 40


def test_progress_outlives_a_restart(spark, source, tmp_path):
    path, items = source
    out, checkpoint, log, calls = str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "log"), []

    def once(batch):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("worker lost")
        return label(batch)

    def start():
        stream = labelling.file_stream(spark, path, items.schema, files_per_batch=1)
        return labelling.start_labelling(stream, once, out, checkpoint)

    with labelling.ProgressLog(spark, log):
        with pytest.raises(StreamingQueryException):
            start().awaitTermination()
    with labelling.ProgressLog(spark, log):  # another driver
        start().awaitTermination()
    found = labelling.logged_progress(spark, log)
    assert values(found, "batch_id", "n_rows") == values(labelling.batch_counts(spark, out), "batch_id", "n_rows")
    assert found.select("run_id").distinct().count() == 2


def test_bad_rows_go_to_errors(spark, source, tmp_path):
    path, items = source
    out = str(tmp_path / "out")

    def checked(batch):
        return label(batch).withColumn("error", F.when(F.col("id") % 4 == 0, "bad"))

    stream = labelling.file_stream(spark, path, items.schema)
    labelling.start_labelling(stream, checked, out, str(tmp_path / "ck")).awaitTermination()
    assert labelling.labelled_rows(spark, out).count() == 30
    assert spark.read.parquet(f"{out}/errors").count() == 10
