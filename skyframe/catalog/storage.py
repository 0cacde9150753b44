"""Small files on any file system Spark can reach, through Hadoop's API."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by path or URI."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str = "") -> str:
        return f"{self.path}/{name}" if name else self.path

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.at(name))))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write aside, then rename, so that readers never see half a file."""
        self.make("/".join(name.split("/")[:-1]))
        aside = self._path(self.at(f"{name}.writing"))
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.delete(self._path(self.at(name)), False)
        if not self.fs.rename(aside, self._path(self.at(name))):
            raise OSError(f"cannot write {self.at(name)}")

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; False if it does (used as a lock)."""
        try:
            stream = self.fs.create(self._path(self.at(name)), False)
        except Exception as e:  # noqa: BLE001  py4j wraps the Java error
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(self.at(name)))

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self._path(self.at(a)), self._path(self.at(b))):
            raise OSError(f"cannot rename {self.at(a)}")

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(self.at(name)), True)
