"""Small files on any Hadoop file system, from the driver: commits, listings, the writer's lock."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def _local(self, path: str) -> str | None:
        """The path of a local file, or None on another file system."""
        full = self._system(path).makeQualified(self._path(path)).toUri()
        return full.getPath() if full.getScheme() == "file" else None

    def make_dir(self, path: str) -> None:
        self._system(path).mkdirs(self._path(path))

    def exists(self, path: str) -> bool:
        return self._system(path).exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._system(path).listStatus(self._path(path))) if self.exists(path) else []

    def size(self, path: str) -> int:
        return self._system(path).getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def delete(self, path: str) -> None:
        self._system(path).delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self._system(path).open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_if_absent(self, path: str, text: str) -> bool:
        """Makes path with all of text, or leaves it alone if it exists: then False. Readers never see a part of it."""
        parent, name = path.rsplit("/", 1)
        draft = f"{parent}/.{name}.{uuid.uuid4().hex}"
        stream = self._system(draft).create(self._path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if local := self._local(draft):
                os.link(local, self._local(path))
            else:
                options = self._jvm.org.apache.hadoop.fs.Options.Rename
                none = self._jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf).rename(self._path(draft), self._path(path), none)
            return True
        except FileExistsError:
            return False
        except Exception as e:  # a rename onto a file that exists
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            if self.exists(draft):
                self.delete(draft)
