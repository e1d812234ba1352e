"""Files that one writer alone can make, for numbers and versions that several processes take."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession


class Exclusive:
    """Numbered files in a folder. A number belongs to whoever made its file, whole from its first moment on.

    On the local file system a hard link, elsewhere a rename that does not replace, decides; both
    fail where the name is taken. (On an object store this holds if its connector's rename does.)
    """

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway, self.path = spark.sparkContext._jvm, spark.sparkContext._gateway, path
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(path).getFileSystem(self._conf)
        self._local = self._fs.getScheme() == "file"

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _plain(self, path: str) -> str:
        return self._at(path).toUri().getPath()

    def taken(self) -> dict[int, float]:
        """The numbers that are taken, in order, and when they were (seconds since 1970)."""
        if not self._fs.exists(self._at(self.path)):
            return {}
        found = [(x.getPath().getName(), x.getModificationTime() / 1000) for x in self._fs.listStatus(self._at(self.path))]
        return {int(n): t for n, t in sorted(found) if n.isdigit()}

    def take(self, number: int, text: str = "") -> bool:
        """Make the file of a number, holding text; False if the number is taken."""
        draft, target = f"{self.path}/.draft-{uuid.uuid4().hex}", f"{self.path}/{number:012d}"
        out = self._fs.create(self._at(draft))
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._local:
                os.link(self._plain(draft), self._plain(target))
            else:
                self._rename(draft, target)
            return True
        except FileExistsError:
            return False
        finally:
            self._fs.delete(self._at(draft), False)

    def _rename(self, draft: str, target: str) -> None:
        from py4j.protocol import Py4JJavaError

        keep = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(self._at(target).toUri(), self._conf).rename(self._at(draft), self._at(target), keep)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise FileExistsError(target) from None
            raise

    def next(self, after: int) -> int:
        """Take the least free number above one."""
        number = after + 1
        while not self.take(number):
            number += 1
        return number

    def text(self, number: int) -> str:
        stream = self._fs.open(self._at(f"{self.path}/{number:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def forget(self, below: int, seconds: float) -> None:
        """Delete the files of numbers below one whose next number was taken so many seconds ago or longer."""
        taken, before = self.taken(), time.time() - seconds
        for n, after in zip(taken, list(taken)[1:]):
            if n < below and taken[after] < before:
                self._fs.delete(self._at(f"{self.path}/{n:012d}"), False)
