"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE sizes broadcasts from measured shuffle output, coalesces small partitions
# and splits skewed ones; the operators lean on it instead of fixed hints.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# a setting of Spark's: shuffle files go when the statement that made them has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app_name: str = "shelfwise", **conf: str) -> SparkSession:
    """Session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    settings = {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors would not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="shelfwise-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def new_path(spark: SparkSession, name: str) -> str:
    """A path no earlier run has written, inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/shelfwise/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back.

    For small aggregates of large tables that large tables are joined with. The
    optimizer knows the size of a written table: it broadcasts a small one, where
    a plain aggregate is assumed as large as its input and the large side would
    be shuffled by what may be a hot key. A larger one is shuffled as usual.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    # what was shuffled for it is not read again; a table that is
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # the setting is read when a frame is made, also by the writer
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete what ``stored`` has written, of a table that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
