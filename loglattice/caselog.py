"""A log of commits in a shared folder, through Hadoop's FileSystem: local disks, HDFS and object stores alike.

Commit n is the file ``log/<n>.json``.  It is written under a name of its own and renamed; the
rename fails if the number is taken, so of two writers one has to look again.  Readers see a
commit whole or not at all, and data that no commit names do not count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

TRIES = 100


class Folder:
    """A folder of a Hadoop file system, as the driver sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._java(self.path).getFileSystem(self._conf)

    def _java(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._java(self.at(name) if name else self.path))

    def names(self, name: str = "") -> list[tuple[str, int]]:
        """(name, time of change in ms) of what lies in a folder, nothing if there is none."""
        if not self.exists(name):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self._java(self.at(name) if name else self.path))]

    def read(self, name: str) -> str:
        stream = self._fs.open(self._java(self.at(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Write a file that nobody has written yet; False if somebody has."""
        target, draft = self._java(self.at(name)), self._java(self.at(f"{name}.{uuid.uuid4().hex}.part"))
        stream = self._fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        try:
            files.rename(draft, target, how)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._java(self.at(name) if name else self.path), True)


class CommitLog:
    """The commits of one folder, read anew whenever they are asked for."""

    def __init__(self, folder: Folder):
        self.folder = folder
        self._known: list[dict] = []

    def entries(self) -> list[dict]:
        """All commits in order; a commit never changes, so only new ones are read."""
        there = {name for name, _ in self.folder.names("log")}
        while self._name(len(self._known)) in there:
            self._known.append(json.loads(self.folder.read(f"log/{self._name(len(self._known))}")))
        return list(self._known)

    def commit(self, make: Callable[[list[dict]], dict | None]) -> dict | None:
        """Append what ``make`` says about the commits so far; it is asked again after each that came in between, and may say None."""
        for _ in range(TRIES):
            entry = make(self.entries())
            if entry is None:
                return None
            if self.folder.write_new(f"log/{self._name(len(self._known))}", json.dumps(entry)):
                return entry
        raise RuntimeError("other writers kept committing")

    @staticmethod
    def _name(n: int) -> str:
        return f"{n:010d}.json"
