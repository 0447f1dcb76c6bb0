"""Tables that are replaced in one step.

A table is a folder of versions and a small file that names the one that counts. A change writes a whole new
version and then replaces that file: readers see all of the old rows or all of the new ones, and a job that
dies before the last step leaves the old version as it was. Bulk updates, id migrations and purges of tables
without day folders are changes of this kind.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.sources import folders


class Changed(RuntimeError):
    """The table got a new version while a change was under way."""


class VersionedTable:
    """``root`` on shared storage. One writer at a time is expected; a second one is told so (``Changed``)
    unless both reach the last step in the same moment."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> str | None:
        """Name of the version that counts."""
        return folders.read_text(self.spark, f"{self.root}/_current")

    def read(self) -> DataFrame:
        """The rows of now: what is planned on them keeps reading this version, also after a change."""
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"{self.root} has no version yet")
        return self.spark.read.parquet(f"{self.root}/{version}")

    def replace(self, rows: DataFrame, expected: str | None = None, partitions: tuple[str, ...] = ()) -> str:
        """Make ``rows`` the table, if ``expected`` (by default what counts now) still counts then.

        The version before stays for readers under way; older ones and those of failed changes go."""
        before = self.current() if expected is None else expected
        version = f"version-{uuid.uuid4().hex}"
        rows.write.partitionBy(*partitions).parquet(f"{self.root}/{version}")
        if self.current() != before:
            folders.delete(self.spark, f"{self.root}/{version}")
            raise Changed(self.root)
        folders.replace_text(self.spark, f"{self.root}/_current", version)
        for name in folders.children(self.spark, self.root):
            if name.startswith("version-") and name not in (version, before):
                folders.delete(self.spark, f"{self.root}/{name}")
        return version

    def update(self, change: Callable[[DataFrame], DataFrame], partitions: tuple[str, ...] = ()) -> str:
        """Replace the table by ``change`` of its rows."""
        before = self.current()
        return self.replace(change(self.read()), before, partitions)
