"""Files of a store through Hadoop's file systems, so that a store may lie wherever Spark can read."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        path = self._path("")
        self.fs = path.getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"
        self.base = self.fs.makeQualified(path).toUri().getPath()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def size(self, name: str) -> int:
        """Bytes of a file or of all files below a folder; -1 where there is none."""
        p = self._path(name)
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else -1

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a whole new file; False, and nothing is changed, where it exists already."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        self.fs.mkdirs(self._path(os.path.dirname(name)))
        stream = self.fs.create(self._path(part), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.local:
                os.link(f"{self.base}/{part}", f"{self.base}/{name}")
                return True
            rename = self.jvm.org.apache.hadoop.fs.Options.Rename
            kinds = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
            kinds[0] = rename.NONE
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf).rename(self._path(part), self._path(name), kinds)
            return True
        except FileExistsError:
            return False
        except Exception:
            if self.exists(name):
                return False
            raise
        finally:
            if self.exists(part):
                self.delete(part)

    def delete(self, name: str) -> None:
        """Delete a file or folder; one that is missing is fine."""
        self.fs.delete(self._path(name), True)

    def capacity(self) -> int:
        """Bytes of the whole file system that the store lies on."""
        return self.fs.getStatus(self._path("")).getCapacity()

    def free(self) -> int:
        return self.fs.getStatus(self._path("")).getRemaining()
