"""Tables of one project and branch, written whole and put in place at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class NotIndexedError(LookupError):
    """The project has no snapshot yet."""


class Store:
    """Parquet tables under a folder that all executors share. Each write is a folder of its own; a
    table's ``CURRENT`` file names the one that counts and is replaced in one step, so a reader sees the
    old or the new version, never none and never half of one. The version before stays for those that
    still read it; older ones are deleted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _versions(self, table: str) -> list[str]:
        """The version that counts and the one before, as the pointer has them."""
        pointer = self._path(f"{self.folder}/{table}/CURRENT")
        if not self._fs.exists(pointer):
            return []
        stream = self._fs.open(pointer)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def exists(self, table: str) -> bool:
        return bool(self._versions(table))

    def read(self, table: str) -> DataFrame:
        versions = self._versions(table)
        if not versions:
            raise NotIndexedError(f"there is no table {table} in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{table}/{versions[0]}")

    def read_or_none(self, table: str) -> DataFrame | None:
        return self.read(table) if self.exists(table) else None

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Replaces a table; ``rows`` may read the old version."""
        version, home = f"v-{uuid.uuid4().hex}", f"{self.folder}/{table}"
        rows.write.parquet(f"{home}/{version}")
        kept = [version, *self._versions(table)[:1]]
        staged = self._path(f"{home}/.{version}")
        out = self._fs.create(staged)
        out.write(bytearray("\n".join(kept).encode()))
        out.close()
        overwrite = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        overwrite[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        self._context.rename(staged, self._path(f"{home}/CURRENT"), overwrite)
        for status in self._fs.listStatus(self._path(home)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in kept:
                self._fs.delete(status.getPath(), True)
        return self.read(table)
