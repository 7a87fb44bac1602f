"""Small files on any Hadoop file system, through the JVM: what a store's manifest needs."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        found = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        finally:
            found.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a whole file that must not exist yet; False if it does. No reader ever sees a part of it.

        The text is written under another name first. HDFS renames atomically and not onto a file; a
        local file gets its name by a hard link, since Hadoop's local rename and create only look first.
        """
        path, draft = self._path(name), self._path(f"{name.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if path.toUri().getScheme() in (None, "file") and self._fs.getScheme() == "file":
                files, java = self._jvm.java.nio.file.Files, lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    files.createLink(java(path), java(draft))
                except Exception:
                    if self._fs.exists(path):
                        return False
                    raise
                return True
            if self._fs.rename(draft, path):
                return True
            if self._fs.exists(path):
                return False
            raise OSError(f"can't make {path}")
        finally:
            self._fs.delete(draft, False)

    def age_ms(self, name: str) -> int:
        now = self._jvm.java.lang.System.currentTimeMillis()
        return now - self._fs.getFileStatus(self._path(name)).getModificationTime()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
