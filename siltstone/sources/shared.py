"""Tables written to the cluster's shared folder, to cut lineage and to outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Without that setting a local session, as in tests, gets a temporary one; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _LOCAL[app]


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a file or a folder of the shared folder; one that isn't there does no harm."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """Parquet tables of one operator call under the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str = "t", once: bool = False) -> DataFrame:
        """Writes ``df`` and reads it back: what depends on it is recomputed from the files alone.

        The shuffle files that the write has made stay until the driver collects its garbage, or go with the end of the write if ``once``.
        """
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true" if once else before)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._siltstone_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Removes saved tables that nothing reads any more."""
        for df in saved:
            delete_path(self.spark, df._siltstone_path)

    def drop_all(self) -> None:
        """Removes everything that was saved here."""
        delete_path(self.spark, self.root)
