"""Tables that change from one whole state to the next.

Data files are only ever added, in a folder of their own per commit. A state is a small list of partition folders; the next
state's list is written beside it and renamed into place, which is the commit. Readers resolve the newest list and
see that state until the end of their job; a writer that fails leaves folders that no list names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STATES, COMMIT = "_states", "v"


class Snapshots:
    """The states of one table; ``path`` may be in any file system that Spark can write and that renames atomically."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._fs.Path("/".join((self.path, *parts)))

    def _names(self, *parts: str) -> list[str]:
        where = self._at(*parts)
        system = where.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(STATES) if n.endswith(".json") and not n.startswith((".", "_")))

    def folders(self, version: int | None = None) -> list[str]:
        """Partition folders of a state, the newest if none is named; no state has none."""
        known = self.versions()
        if version is None and not known:
            return []
        where = self._at(STATES, f"{known[-1] if version is None else version:012d}.json")
        stream = where.getFileSystem(self._conf).open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, layout: T.StructType, version: int | None = None) -> DataFrame:
        """``layout`` names the partition column as well; filters on it drop folders before any file is listed."""
        folders = self.folders(version)
        if not folders:
            return self.spark.createDataFrame([], layout)
        known = T.StructType([*layout.fields, T.StructField(COMMIT, T.StringType())])
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(known).option("basePath", self.path).parquet(*paths).drop(COMMIT)

    def replace(self, rows: DataFrame, part: str, everything: bool = False) -> int:
        """Commit ``rows``, complete in the partitions that they touch; the others stay, unless ``everything`` goes.

        Returns the new state's number. Two writers that start from one state can't both commit: the later one fails.
        """
        known = self.versions()
        before = known[-1] if known else 0
        old = [] if everything or not known else self.folders(before)
        commit = f"{COMMIT}={uuid.uuid4().hex}"
        rows.write.partitionBy(part).parquet(f"{self.path}/{commit}")
        new = [f"{commit}/{n}" for n in self._names(commit) if "=" in n]
        touched = {f.split("/", 1)[1] for f in new}
        self._commit(before + 1, [f for f in old if f.split("/", 1)[1] not in touched] + new)
        return before + 1

    def _commit(self, version: int, folders: list[str]) -> None:
        draft, final = self._at(STATES, f"_{uuid.uuid4().hex}"), self._at(STATES, f"{version:012d}.json")
        out = draft.getFileSystem(self._conf).create(draft, False)
        try:
            out.write(bytearray(json.dumps(folders).encode()))
        finally:
            out.close()
        files = self._fs.FileContext.getFileContext(final.toUri(), self._conf)
        strict = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)  # never overwrites
        files.rename(draft, final, strict)

    def expire(self, keep: int = 1) -> int:
        """Delete all but the newest ``keep`` states and what only they, or failed writers, left. No writer may run."""
        known = self.versions()
        named = {f.split("/", 1)[0] for v in known[-keep:] for f in self.folders(v)}
        gone = [(STATES, f"{v:012d}.json") for v in known[:-keep]]
        gone += [(n,) for n in self._names() if n.startswith(f"{COMMIT}=") and n not in named]
        for parts in gone:
            where = self._at(*parts)
            where.getFileSystem(self._conf).delete(where, True)
        return len(gone)
