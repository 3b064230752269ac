"""Tables whose writes take effect all at once.

A table is a folder with data folders, each written by one job, and numbered manifests
that list the data folders of a version. A write adds a data folder and then, as its last
act, the next manifest: until then readers see the version before, so a job that dies
leaves the table as it was, and a write may read the table it replaces. A write with a
``key`` that is already in the table does nothing, so a job that is run again after its
last act adds nothing twice. Two writers that started from the same version cannot both
go on: the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfwise.sources import files


class Conflict(Exception):
    """Another write came first; read the table again and repeat."""


@dataclass(frozen=True)
class Version:
    number: int
    folders: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}.json"

    def version(self, number: int | None = None) -> Version:
        """The last version, or a given one; version 0 is a table that was never written."""
        if number is None:
            found = [n for n in files.names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
            number = int(found[-1].split(".")[0]) if found else 0
        if number == 0:
            return Version(0)
        kept = json.loads(files.read_text(self.spark, self._manifest(number)))
        return Version(number, tuple(kept["folders"]), tuple(kept["keys"]))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version. What is read stays as it is while later versions are written."""
        found = self.version(number)
        if not found.folders:
            raise FileNotFoundError(f"{self.path} has no rows yet")
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in found.folders])

    def _write(self, df: DataFrame, base: Version, key: str | None, add: bool, partition_by: list[str] | None) -> Version:
        if key is not None and key in base.keys:
            return base
        folder = f"{base.number + 1:012d}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/data/{folder}")
        return self._switch(base, (*base.folders, folder) if add else (folder,), key)

    def _switch(self, base: Version, folders: tuple[str, ...], key: str | None) -> Version:
        after = Version(base.number + 1, folders, (*base.keys, key) if key is not None else base.keys)
        text = json.dumps({"folders": after.folders, "keys": after.keys})
        try:
            files.write_new(self.spark, self._manifest(after.number), text)
        except FileExistsError:
            raise Conflict(f"{self.path} has a version {after.number} already") from None
        return after

    def replace(self, df: DataFrame, key: str | None = None, partition_by: list[str] | None = None) -> Version:
        """All rows anew; ``df`` may read this table."""
        return self._write(df, self.version(), key, False, partition_by)

    def append(self, df: DataFrame, key: str | None = None, partition_by: list[str] | None = None) -> Version:
        """Further rows; ``df`` may read this table."""
        return self._write(df, self.version(), key, True, partition_by)

    def update(self, change: Callable[[DataFrame], DataFrame], key: str | None = None) -> Version:
        """What ``change`` makes of the rows, in their place."""
        base = self.version()
        return self._write(change(self.read(base.number)), base, key, False, None)

    def clean(self, keep: int = 1) -> int:
        """Delete data folders that the last ``keep`` versions do not list; returns how many.

        This includes what dead jobs have left, so no write may be under way.
        """
        last = self.version().number
        used = {f for n in range(max(1, last - keep + 1), last + 1) for f in self.version(n).folders}
        unused = [f for f in files.names(self.spark, f"{self.path}/data") if f not in used]
        for folder in unused:
            files.remove(self.spark, f"{self.path}/data/{folder}")
        for number in range(1, last - keep + 1):
            if files.exists(self.spark, self._manifest(number)):
                files.remove(self.spark, self._manifest(number))
        return len(unused)
