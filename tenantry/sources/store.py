"""Atomic commits of states: staged folders and one pointer for each version.

A commit writes the tables that changed into a folder of its own, then a pointer that names the folder of every table,
and makes the pointer visible by one rename that fails if that version exists. A reader opens a pointer, so it sees all
of a commit or nothing of it; a failing write leaves the last version as it was. Tables that did not change are not
written again. Data are plain Parquet.

The rename is atomic, and refuses an existing name, on HDFS and file systems like it; on an object store without such
a rename the writers of one store must take turns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLES
from .workspace import exists, hadoop_path, remove

State = dict[str, DataFrame]


class StaleVersion(RuntimeError):
    """Another writer has committed since the state was read."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}.json"

    def version(self) -> int:
        """The last committed version, 0 if there is none."""
        p, fs = hadoop_path(self.spark, f"{self.root}/versions")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def paths(self, version: int) -> dict[str, str]:
        """The folder of each table at a version."""
        if version == 0:
            return {}
        lines = self.spark.read.option("wholetext", True).text(self._pointer(version)).first()[0]
        return {n: f"{self.root}/{p}" for n, p in json.loads(lines).items()}

    def state(self, version: int | None = None) -> tuple[State, int]:
        """(tables, version): what a version holds, the last one unless told."""
        at = self.version() if version is None else version
        return {n: self.spark.read.schema(TABLES[n].struct).parquet(p) for n, p in self.paths(at).items()}, at

    def commit(self, old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], expected: int, violations: DataFrame | None = None) -> int | None:
        """Make ``new`` the next version and return its number; None, and nothing written, if there are violations.

        ``old`` is the state that was read, at version ``expected``: its tables that are the same objects in new are
        not written. A version that another writer committed meanwhile is an error, and stays.
        """
        if self.version() != expected:
            raise StaleVersion(f"version {self.version()}, expected {expected}")
        if violations is not None and not violations.isEmpty():
            return None
        known = self.paths(expected)
        changed = {n: df for n, df in new.items() if n not in known or df is not old.get(n)}
        staged = f"data/{expected + 1:012d}-{uuid.uuid4().hex}"
        try:
            for n, df in changed.items():
                struct = TABLES[n].struct
                df.select(*struct.names).write.parquet(f"{self.root}/{staged}/{n}")
            kept = {n: p.removeprefix(f"{self.root}/") for n, p in known.items()}
            self._publish(kept | {n: f"{staged}/{n}" for n in changed}, expected + 1)
        except BaseException:
            remove(self.spark, f"{self.root}/{staged}")
            raise
        return expected + 1

    def _publish(self, folders: dict[str, str], version: int) -> None:
        jvm, name = self.spark._jvm, self._pointer(version)
        draft, fs = hadoop_path(self.spark, f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(folders, sort_keys=True).encode())
        out.close()
        target, _ = hadoop_path(self.spark, name)
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, target, options)
        except Exception as e:
            fs.delete(draft, False)
            if exists(self.spark, name):
                raise StaleVersion(f"version {version} is there") from e
            raise

    def vacuum(self, keep: int = 1) -> None:
        """Delete what only versions before the last ``keep`` name, and their pointers. No reader may be on them."""
        last = self.version()
        live = {p for v in range(max(1, last - keep + 1), last + 1) for p in self.paths(v).values()}
        for v in range(1, max(1, last - keep + 1)):
            if exists(self.spark, self._pointer(v)):
                for p in self.paths(v).values():
                    if p not in live:
                        remove(self.spark, p)
                remove(self.spark, self._pointer(v))
