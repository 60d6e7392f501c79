"""Small metadata files beside the data, on any file system that Spark can reach."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from ..errors import DirectoryLocked, VersionConflict


class Files:
    """Lists, reads, publishes and deletes under one root."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        at = self._path(root)
        self._fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(at).toString().rstrip("/")
        self.local = self.root.removeprefix("file:") if self.root.startswith("file:") else None
        if self.local:
            self.local = "/" + self.local.lstrip("/")

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Make a file appear whole and only if it does not exist; else raise VersionConflict."""
        draft = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(f"{self.root}/{draft}"), False)
        try:
            self._io.write(text, stream, "UTF-8")
        finally:
            stream.close()
        try:
            if self.local:  # a hard link fails if the name is taken, a local rename would overwrite
                try:
                    os.link(f"{self.local}/{draft}", f"{self.local}/{name}")
                except FileExistsError:
                    raise VersionConflict(name) from None
            elif not self._fs.rename(self._path(f"{self.root}/{draft}"), self._path(f"{self.root}/{name}")):
                raise VersionConflict(name)
        finally:
            self._fs.delete(self._path(f"{self.root}/{draft}"), False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/{name}"))


class WriterLock:
    """One writing process a local store; other file systems rely on publishing alone."""

    def __init__(self, files: Files):
        self._file = None
        if files.local:
            import fcntl

            self._file = open(f"{files.local}/LOCK", "a")  # noqa: SIM115
            try:
                fcntl.flock(self._file, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                self._file.close()
                raise DirectoryLocked(files.root) from None

    def release(self) -> None:
        if self._file:
            self._file.close()
            self._file = None
