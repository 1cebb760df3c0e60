"""Small files of metadata on any file system that Hadoop knows."""

from __future__ import annotations

import json
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..status import Corruption, IOErr


class Files:
    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._jvm = jvm
        path = self._path(root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(path).toString().rstrip("/")

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._at(name))

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def read(self, name: str) -> Any:
        try:
            stream = self.fs.open(self._at(name))
            try:
                data = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
            return json.loads(data)
        except ValueError as e:
            raise Corruption(f"{name}: {e}") from None
        except Py4JJavaError as e:
            raise IOErr(f"{name}: {e.java_exception.getMessage()}") from None

    def write(self, name: str, content: Any, overwrite: bool = False) -> bool:
        """Whole or not at all; False if the file is there and isn't to be replaced.

        The content goes to a file of another name, is synced, and is renamed."""
        target, part = self._at(name), self._at(f"{name}.part")
        if not overwrite and self.fs.exists(target):
            return False
        try:
            stream = self.fs.create(part, True)
            stream.write(bytearray(json.dumps(content).encode()))
            stream.hsync()
            stream.close()
            if overwrite:
                self.fs.delete(target, False)
            if not self.fs.rename(part, target):
                raise IOErr(f"cannot rename to {name}")
        except Py4JJavaError as e:
            raise IOErr(f"{name}: {e.java_exception.getMessage()}") from None
        return True
