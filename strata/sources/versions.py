"""Tables and models as versions: a table can be read and replaced by the same job.

Rows are written to a folder of their own, and then published by a small pointer file whose number is
one more than that of the pointer before.  A pointer appears whole, by a rename that fails if the
number is taken, so readers see the old version or the new one, and of two writers one is
told that it lost.  A job that is killed before it publishes leaves only a folder that no
pointer names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.operators.score import Scorer

POINTER = re.compile(r"pointer-(\d{12})")


class Conflict(RuntimeError):
    """Another writer published first."""


class VersionedTable:
    """A Parquet table under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """Published versions, ascending."""
        here = self._path(self.root)
        if not self._fs.exists(here):
            return []
        found = (POINTER.fullmatch(f.getPath().getName()) for f in self._fs.listStatus(here))
        return sorted(int(m[1]) for m in found if m)

    def _folder(self, version: int) -> str:
        name = f"{self.root}/pointer-{version:012d}"
        return f"{self.root}/{json.loads(self.spark.read.text(name, wholetext=True).first()[0])['folder']}"

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or the one asked for."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.root} has no version {'' if version is None else version}".rstrip())
        return self.spark.read.parquet(self._folder(known[-1] if version is None else version))

    def stage(self, df: DataFrame) -> str:
        """Write ``df`` where no reader looks; the name to ``publish``."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def publish(self, folder: str, after: int | None = None) -> int:
        """Make ``folder`` the newest version; with ``after`` only if that is the newest until now."""
        known = self.versions()
        newest = known[-1] if known else 0
        if after is not None and after != newest:
            raise Conflict(f"version {newest} was published meanwhile")
        target = self._path(f"{self.root}/pointer-{newest + 1:012d}")
        draft = self._path(f"{self.root}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"folder": folder}).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {newest + 1} was published meanwhile")
        return newest + 1

    def write(self, df: DataFrame) -> int:
        return self.publish(self.stage(df))

    def replace(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """SK1: read the newest version, write what ``change`` makes of it, publish it if no one else has
        published since."""
        known = self.versions()
        return self.publish(self.stage(change(self.read())), after=known[-1] if known else 0)

    def expire(self, keep: int = 2) -> int:
        """Remove all but the newest ``keep`` versions; how many went."""
        gone = self.versions()[:-max(1, keep)]
        for v in gone:
            folder = self._folder(v)
            self._fs.delete(self._path(f"{self.root}/pointer-{v:012d}"), False)
            self._fs.delete(self._path(folder), True)
        return len(gone)


def save_scorer(spark: SparkSession, scorer: Scorer, root: str) -> int:
    """SK2: the whole bundle (scaler, k-means, logistic regression, imputer, components, threshold, labels,
    bands and risk rules) as a new version; plain values, no pickles."""
    return VersionedTable(spark, root).write(spark.createDataFrame([(json.dumps(scorer.params()),)], "params string").coalesce(1))


def load_scorer(spark: SparkSession, root: str, version: int | None = None) -> Scorer:
    """SC5: the scorer rebuilt from the newest version, or the one asked for."""
    return Scorer.from_params(json.loads(VersionedTable(spark, root).read(version).first()["params"]))
