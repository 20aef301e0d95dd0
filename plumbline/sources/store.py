"""Files of a run's own store, whatever it is: local disk, HDFS, an object store.

Spark's file systems are used on the driver, for a few files at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """A folder of the store."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.base = self._fs.makeQualified(self._path("")).toString().rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        """What is in a folder; nothing if there is none."""
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def files(self, folder: str = "") -> list[str]:
        """All files below a folder, as names from it."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        base = self._fs.makeQualified(path).toString().rstrip("/")
        out, found = [], self._fs.listFiles(path, True)
        while found.hasNext():
            out.append(found.next().getPath().toString().removeprefix(base).lstrip("/"))
        return sorted(out)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def move(self, name: str, to: str) -> None:
        """Rename; a missing file, which another run has moved, is no error."""
        target = self._path(to)
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(self._path(name)):
            self._fs.rename(self._path(name), target)

    def write_text(self, name: str, text: str) -> None:
        """A whole file: it has its name once it has its text."""
        new = f"{name}.new"
        out = self._fs.create(self._path(new), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.delete(name)
        if not self._fs.rename(self._path(new), self._path(name)):
            raise OSError(f"{self.root}/{name} could not be written")


def arrow_path(path: str):
    """Arrow's file system and path of an address, for what tasks write themselves; None where Arrow has none."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    except Exception:  # noqa: BLE001  an address, or a library, that Arrow does not have
        return None


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the store that all executors share, and read again: it is worked out once."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
