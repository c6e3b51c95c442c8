"""Small files and folders through Hadoop's file systems, so that a catalog may live wherever Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self, name: str = ""):
        return self._path(name).getFileSystem(self._conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs(name).exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs(name).open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, data: str | bytes) -> bool:
        """Writes a new file; False, and nothing written, where one of that name exists."""
        if self.exists(name):
            return False
        try:
            stream = self._fs(name).create(self._path(name), False)
        except Exception as e:  # another process was first
            if "FileAlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(data.encode() if isinstance(data, str) else data))
        finally:
            stream.close()
        return True

    def rename(self, name: str, to: str) -> None:
        if not self._fs(name).rename(self._path(name), self._path(to)):
            raise OSError(f"{name} can't be renamed to {to}")

    def stream(self, name: str):
        """An open stream of a new file, for contents that aren't held as a whole."""
        return self._fs(name).create(self._path(name), True)

    def delete(self, name: str) -> None:
        self._fs(name).delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs(name).listStatus(self._path(name)))

    def size(self, name: str) -> int:
        return self._fs(name).getContentSummary(self._path(name)).getLength() if self.exists(name) else 0
