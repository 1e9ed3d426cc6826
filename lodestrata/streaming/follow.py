"""A growing file as a stream of lines, across rotation.

spark.readStream.format("growing").option("path", ...).load() gives (offset, line) of whole lines, each once. A file
that became shorter, or is another file by its device and number, was rotated: what the old one still held is read from
ROTATED beside it, then the new one from its start. The file must be one that the machines see by its path.

Defined results: a missing file has no lines yet; a line without its end waits; bytes that aren't UTF-8 are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Suffix of the file that a rotation leaves.
ROTATED = ".1"
#: Bytes of one read.
MOST = 1 << 22


class GrowingReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.rotated = options["path"], options["path"] + options.get("rotated", ROTATED)
        self.most = int(options.get("most", MOST))

    def initialOffset(self) -> dict:
        return {"at": 0, "file": ""}

    @staticmethod
    def _mark(path: str) -> str:
        try:
            s = os.stat(path)
        except OSError:
            return ""
        return f"{s.st_dev}:{s.st_ino}"

    def _lines(self, path: str, start: int, end: int | None) -> tuple[list[tuple[int, str]], int]:
        """Whole lines from start, and where the next one begins."""
        try:
            with open(path, "rb") as f:
                f.seek(start)
                data = f.read(self.most if end is None else end - start)
        except OSError:
            return [], start
        whole = data[: data.rfind(b"\n") + 1]
        out, at = [], start
        for line in whole.splitlines(keepends=True):
            out.append((at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
            at += len(line)
        return out, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        mark = self._mark(self.path)
        size = os.path.getsize(self.path) if mark else 0
        if start["file"] and (mark != start["file"] or size < start["at"]):
            # the old file's rest comes first, if it is still there
            if self._mark(self.rotated) == start["file"]:
                rows, at = self._lines(self.rotated, start["at"], None)
                if rows:
                    return iter(rows), {"at": at, "file": start["file"]}
            return iter([]), {"at": 0, "file": mark}
        rows, at = self._lines(self.path, start["at"], None)
        return iter(rows), {"at": at, "file": mark}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same lines again, after a failure."""
        if start == end or end["at"] <= start["at"] and end["file"] != start["file"]:
            return iter([])
        path = self.path if self._mark(self.path) == end["file"] else self.rotated
        return iter(self._lines(path, start["at"] if start["file"] in ("", end["file"]) else 0, end["at"])[0])


class Growing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing"

    def schema(self) -> str:
        return "offset long, line string"

    def simpleStreamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Growing)
    return spark
