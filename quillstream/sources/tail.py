"""A streaming source that follows a growing JSON-lines file."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ANCHOR = 4096


class Replaced(RuntimeError):
    """The file was truncated or replaced; the query must start anew with another checkpoint."""


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    """Offsets are bytes up to the last full line, with a digest of the file's first bytes and its inode.

    A partial last line waits until its end is there, or until option ``final`` says that none will
    come. A shorter file, another inode, or one that begins with other bytes than before, was
    replaced, which is an error: rows that were given out can't be recalled. What is new is cut at
    line ends into spans of about ``span`` bytes (option; 16 MB), read by a task each, line by line.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.final = options.get("final", "false").lower() == "true"
        self.span = int(options.get("span", 16 << 20))
        self.last: dict | None = None

    def _anchor(self, size: int) -> str:
        with open(self.path, "rb") as f:
            return hashlib.sha256(f.read(min(ANCHOR, size))).hexdigest()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0, "anchored": 0, "anchor": hashlib.sha256(b"").hexdigest(), "inode": 0}

    def _check(self, offset: dict) -> None:
        there = os.path.exists(self.path)
        size, inode = (os.path.getsize(self.path), os.stat(self.path).st_ino) if there else (0, 0)
        other = bool(offset.get("inode")) and inode != offset["inode"]
        if size < offset["at"] or other or (offset["anchored"] and self._anchor(offset["anchored"]) != offset["anchor"]):
            raise Replaced(f"{self.path} was truncated or replaced")

    def _line_end(self, start: int, size: int) -> int:
        """The place behind the last line end between ``start`` and ``size``, looked for from the end in blocks."""
        with open(self.path, "rb") as f:
            end = size
            while end > start:
                begin = max(start, end - (1 << 20))
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return start

    def latestOffset(self) -> dict:  # noqa: N802
        before = self.last or self.initialOffset()
        self._check(before)
        if not os.path.exists(self.path):
            return before
        size = os.path.getsize(self.path)
        end = size if self.final else self._line_end(before["at"], size)
        anchored = min(ANCHOR, end)
        self.last = {"at": end, "anchored": anchored, "anchor": self._anchor(anchored), "inode": os.stat(self.path).st_ino if end else 0}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self._check(start)
        out, at = [], start["at"]
        while at < end["at"]:
            stop = end["at"]
            if stop - at > self.span:
                with open(self.path, "rb") as f:
                    f.seek(at + self.span)
                    f.readline()
                    stop = min(f.tell(), end["at"])
            out.append(Span(self.path, at, stop))
            at = stop
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline(partition.end - at)
                if not line:
                    return
                text = line.decode("utf-8-sig").strip()
                if text:
                    if not isinstance(json.loads(text), dict):
                        raise ValueError(f"{partition.path}: the line at byte {at} is not an object")
                    yield (at, text)
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing to release."""


class TailSource(DataSource):
    """spark.readStream.format("jsonl_tail").option("path", ...): (offset, value) per full line.

    The file must be one that the driver and executors both see.
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "offset bigint, value string"

    def streamReader(self, schema: object) -> TailReader:  # noqa: N802
        return TailReader(self.options)
