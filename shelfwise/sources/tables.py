"""Readers, writers and catalog descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.rows import sample_n

DEALT_BYTES = 32 << 20  # of a table's files, for a task
READERS = {"csv": "csv", "parquet": "parquet", "json": "json", "orc": "orc"}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str = ",",
    multi_line: bool = False,
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV with a header; an empty cell, quoted or not, is a missing value.

    Types are inferred, by one more pass, only without a schema.

    A file is split over tasks. ``multi_line`` reads line breaks inside quotes, but
    keeps a file in one task.
    """
    reader = spark.read.options(header=True, sep=sep, multiLine=multi_line, quote='"', escape='"', encoding=encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def dealt(df: DataFrame, at_most: int = DEALT_BYTES) -> DataFrame:
    """The rows of a scan dealt out over the cores, if it has fewer files than these.

    A small table of one file with one row group is otherwise read, and all that follows
    up to the first shuffle is done, by one core. A table of many files stays as it is.
    No part has more than ``at_most`` bytes of the files, so that what a task makes of its
    rows does not grow with the table.
    """
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, -(-_bytes(spark, files) // at_most))
    return df if len(files) >= parts else df.repartition(parts)


def _bytes(spark: SparkSession, files: list[str]) -> int:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read a file or folder by its extension."""
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension == "csv":
        return read_csv(spark, path, schema, **options)
    if extension not in READERS:
        raise ValueError(f"no reader for .{extension}; convert the file to one of {sorted(READERS)}")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(READERS[extension]).load(path)


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def run_sql(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Run a statement; ``{name}`` in the text stands for the frame given as ``name``."""
    return spark.sql(sql, **frames)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A remote table; give ``partitionColumn`` and its bounds to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """One parallel Parquet write; ``append`` adds to what is there."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Write to a catalog table."""
    df.write.mode(mode).saveAsTable(name)


def insert_into(df: DataFrame, name: str) -> None:
    """Append a query result to a table, columns matched by name."""
    df.select(*df.sparkSession.table(name).columns).write.insertInto(name)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header and no row index."""
    df.write.mode("overwrite").options(header=True, sep=sep, quote='"', escape='"').csv(path)


def describe_columns(spark: SparkSession, tables: list[str] | None = None) -> DataFrame:
    """``(table_name, column_name, type_name)`` of the catalog's tables and views."""
    listed = [t.name for t in spark.catalog.listTables()]
    names = sorted(listed if tables is None else set(tables) & set(listed))
    rows = [(t, c.name, c.dataType) for t in names for c in spark.catalog.listColumns(t)]
    return spark.createDataFrame(rows, "table_name string, column_name string, type_name string")


def sample_lines(df: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """``n`` sampled rows as text, nulls spelled ``NULL``."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in df.columns]
    lines = df.select(F.concat_ws(", ", *shown).alias("line"))
    return sample_n(lines, n, "line", seed)


def describe_schema(spark: SparkSession, tables: list[str], n: int = 3) -> DataFrame:
    """One row per table: its columns with types, and sampled rows."""
    columns = (
        describe_columns(spark, tables)
        .groupBy("table_name")
        .agg(
            F.array_join(
                F.array_sort(F.collect_list(F.format_string("%s (%s)", "column_name", "type_name"))), "\n"
            ).alias("columns")
        )
    )
    samples = [
        sample_lines(spark.table(t), n)
        .agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("sample"))
        .withColumn("table_name", F.lit(t))
        for t in tables
    ]
    sampled = reduce(lambda a, b: a.unionByName(b), samples)
    return columns.join(sampled, "table_name").select("table_name", "columns", "sample")
