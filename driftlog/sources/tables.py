"""Tables in Parquet: the driver's, states sorted by key, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Unset, a temporary folder where all run in one process, an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftlog-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and every reader sees the same rows in the same partitions."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_state(state: DataFrame, path: str, key: str = "key", parts: int | None = None, bloom: bool = True) -> None:
    """A state range-partitioned and sorted by key, so that point, range and prefix reads skip files and row groups."""
    n = parts or max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    out = state.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite")
    if bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{key}", "true")
    out.parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class Stale(Exception):
    """The pinned version's files are gone; refresh() takes the latest."""


class StateTable:
    """Versions of a state, each sorted by key, in a folder. A reader pins one version until it is refreshed."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.pinned: int | None = None

    def _fs(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Whole versions only: a write that failed has no success mark."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and (lambda f: f[0].exists(f[1]))(self._fs(f"{n}/_SUCCESS")))

    def flush(self, state: DataFrame, parts: int | None = None) -> int:
        """Write the next version; one writer at a time. Returns its number."""
        number = max(self.versions(), default=0) + 1
        write_state(state, f"{self.path}/v{number}", self.key, parts)
        return number

    def refresh(self) -> int | None:
        self.pinned = max(self.versions(), default=None)
        return self.pinned

    def read(self) -> DataFrame:
        """The pinned version, the latest one at first."""
        if self.pinned is None and self.refresh() is None:
            raise Stale("no version yet")
        if self.pinned not in self.versions():
            raise Stale(f"version {self.pinned} is gone")
        return read_state(self.spark, f"{self.path}/v{self.pinned}")

    def expire(self, keep: int = 1) -> None:
        """Remove all but the latest versions."""
        for n in self.versions()[:-keep]:
            fs, path = self._fs(f"v{n}")
            fs.delete(path, True)
