"""Tables as a series of snapshot directories; a small pointer file names the current one.

A new state is written beside the old one and becomes visible by replacing the pointer, so readers never see half a
write and a failed job changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str, partition_by: list[str] | None = None) -> None:
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), partition_by or []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version, 0 before the first write."""
        if not self._fs.exists(self._path(self.root)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max((int(n[8:]) for n in names if n.startswith("CURRENT-")), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={version or self.version()}")

    def write(self, df: DataFrame) -> int:
        v = self.version() + 1
        w = df.write.mode("overwrite")
        (w.partitionBy(*self.partition_by) if self.partition_by else w).parquet(f"{self.root}/v={v}")
        self._fs.create(self._path(f"{self.root}/CURRENT-{v}"), True).close()
        return v

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions."""
        for v in range(1, self.version() - keep + 1):
            self._fs.delete(self._path(f"{self.root}/CURRENT-{v}"), False)
            self._fs.delete(self._path(f"{self.root}/v={v}"), True)
