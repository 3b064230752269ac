"""Writes that take effect at once, or not at all."""

import pytest
from pyspark.sql import functions as F

from conftest import values
from shelfwise.sources import files
from shelfwise.sources.versions import Conflict, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    out = VersionedTable(spark, str(tmp_path / "table"))
    out.replace(spark.range(10).withColumn("v", F.lit("a")))
    return out


def test_replaces_what_it_reads(table):
    before = table.read()
    table.replace(table.read().where("id < 4").withColumn("v", F.lit("b")))
    assert values(table.read()) == [(i, "b") for i in range(4)]
    assert before.count() == 10 and table.read(1).count() == 10  # readers keep their version
    table.append(table.read().withColumn("id", F.col("id") + 100))
    assert table.read().count() == 8
    table.update(lambda rows: rows.withColumn("v", F.concat("v", F.col("id").cast("string"))))
    assert ("b100" in {r.v for r in table.read().collect()}) and table.version().number == 4


def test_a_job_that_dies_before_the_switch_changes_nothing(spark, table, monkeypatch):
    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(files, "write_new", killed)
    with pytest.raises(KeyboardInterrupt):
        table.replace(spark.range(3).withColumn("v", F.lit("half")))
    monkeypatch.undo()
    assert values(table.read()) == [(i, "a") for i in range(10)] and table.version().number == 1
    assert len(files.names(spark, f"{table.path}/data")) == 2  # written, but not part of the table
    table.replace(spark.range(3).withColumn("v", F.lit("whole")))
    assert table.read().count() == 3
    assert table.clean() == 2 and table.read().count() == 3


def test_a_job_that_dies_while_writing_changes_nothing(spark, table):
    fail = F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.lit("x"))
    with pytest.raises(Exception, match="lost"):
        table.update(lambda rows: rows.withColumn("v", fail))
    assert values(table.read()) == [(i, "a") for i in range(10)]


def test_a_retry_adds_nothing(spark, table):
    more = spark.range(10, 15).withColumn("v", F.lit("b"))
    for _ in range(2):
        table.append(more, key="batch-1")
    assert table.read().count() == 15 and table.version().number == 2


def test_the_second_of_two_writers_fails(spark, table):
    def meanwhile(rows):
        VersionedTable(spark, table.path).append(spark.range(20, 21).withColumn("v", F.lit("first")))
        return rows

    with pytest.raises(Conflict):
        table.update(meanwhile)
    assert table.read().count() == 11


def test_clean_keeps_versions(spark, table):
    for i in range(3):
        table.replace(spark.range(i + 1).withColumn("v", F.lit("c")))
    assert table.clean(keep=2) == 2
    assert table.read().count() == 3 and table.read(3).count() == 2
    with pytest.raises(Exception):
        table.read(1)
    empty = VersionedTable(spark, f"{table.path}-none")
    with pytest.raises(FileNotFoundError):
        empty.read()
    assert empty.clean() == 0
